"""Query-log, session, cache and answer analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow.operators import aggregates, sparse
from corpusflow.operators.querytext import keywords, normalized
from corpusflow.operators.ranking import stable, top_k
from corpusflow.plans import sqlparts as sql
from corpusflow.plans.corpus import PAGE_TEXT, page_texts
from corpusflow.plans.querytext import STOPS
from corpusflow.plans.registry import query
from corpusflow.plans.retrieval import CANDIDATES, OVERLAP, candidates, corpus, corpus_index
from corpusflow.sources.tables import events, queries_of, table

# The query log: an event is a query; its k names the conversation that holds the question.
QUESTIONS = "qs AS (SELECT conv_id AS k, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)"
EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec, ts::DATE AS day, user_id % 5 AS service,
  event_type = 'error' AS is_error, (props->>'$.k')::BIGINT AS k FROM events)"""


def questions(spark, root):
    """First user question of every conversation."""
    return table(spark, root, "conversations").filter("role = 'user'").groupBy(F.col("conv_id").alias("k")).agg(F.min_by("text", "turn").alias("text"))


def daily_questions(spark, root):
    """(day, k, n): events are counted per day and question before any text is joined."""
    return events(spark, root).groupBy("day", "k").agg(F.count("*").alias("n"))


@query("daily_totals", "H1", f"WITH {EV} SELECT day, count(*) AS total FROM ev GROUP BY 1")
def daily_totals(spark, root):
    """Queries per day."""
    return events(spark, root).groupBy("day").agg(F.count("*").alias("total"))


@query("popular_queries", "H2", rf"""WITH {EV}, {QUESTIONS}, c AS (SELECT day, md5(regexp_replace(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-?!.]', '', 'g')) AS query, count(*) AS n FROM ev JOIN qs USING (k) GROUP BY ALL)
SELECT * FROM (SELECT day, query, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, query) AS rank FROM c) WHERE rank <= 10""")
def popular_queries(spark, root):
    """Ten most frequent normalized queries per day."""
    asked = questions(spark, root).select("k", F.md5(normalized(F.col("text"))).alias("query"))
    counts = daily_questions(spark, root).join(asked, "k").groupBy("day", "query").agg(F.sum("n").alias("n"))
    return top_k(counts, ["day"], [F.col("n").desc(), F.col("query")], 10)


@query("intent_distribution", "H3", f"WITH {EV}, c AS (SELECT day, event_type AS intent, count(*) AS n FROM ev GROUP BY ALL) SELECT * FROM (SELECT day, intent, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, intent) AS rank FROM c) WHERE rank <= 5")
def intent_distribution(spark, root):
    """Five most frequent intents per day."""
    counts = events(spark, root).groupBy("day", F.col("event_type").alias("intent")).agg(F.count("*").alias("n"))
    return top_k(counts, ["day"], [F.col("n").desc(), F.col("intent")], 5)


@query("entity_counts", "H4", rf"""WITH {EV}, {QUESTIONS}, e AS (SELECT k, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM qs),
l AS (SELECT k, CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN 'NAME' WHEN len(w) > 9 THEN 'TERM' END AS label, count(*) AS c FROM e GROUP BY ALL)
SELECT day, label, sum(c)::BIGINT AS n FROM ev JOIN l USING (k) WHERE label IS NOT NULL GROUP BY ALL""")
def entity_counts(spark, root):
    """Entities per day and label; capitalized words are names, long words terms."""
    from corpusflow.functions.text import WORD

    word = F.col("w")
    label = F.when(word.rlike(r"^\p{Lu}"), "NAME").when(F.length(word) > 9, "TERM")
    words = questions(spark, root).select("k", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    per_question = words.groupBy("k", label.alias("label")).agg(F.count("*").alias("c")).filter("label is not null")
    return daily_questions(spark, root).join(per_question, "k").groupBy("day", "label").agg(F.sum(F.col("n") * F.col("c")).alias("n"))


KW = rf"""kt AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT k, {sql.WORDS} AS w FROM qs)),
kw AS (SELECT k, w AS keyword FROM (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY min(pos)) AS n FROM kt WHERE len(w) > 2 AND w NOT IN {STOPS} GROUP BY k, w) WHERE n <= 10)"""


@query("popular_keywords", "H5", f"""WITH {EV}, {QUESTIONS}, {KW}, c AS (SELECT day, keyword, count(*) AS n FROM ev JOIN kw USING (k) GROUP BY ALL)
SELECT * FROM (SELECT day, keyword, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, keyword) AS rank FROM c) WHERE rank <= 20""")
def popular_keywords(spark, root):
    """Twenty most frequent keywords per day."""
    found = questions(spark, root).select("k", F.explode(keywords(F.col("text"))).alias("keyword"))
    counts = daily_questions(spark, root).join(found, "k").groupBy("day", "keyword").agg(F.sum("n").alias("n"))
    return top_k(counts, ["day"], [F.col("n").desc(), F.col("keyword")], 20)


@query("daily_latency", "H6", f"""WITH {EV} SELECT day, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev WHERE value > 0 GROUP BY 1""")
def daily_latency(spark, root):
    """Exact processing-time percentiles per day."""
    out = aggregates.percentiles(events(spark, root).filter("value > 0"), ["day"], "value", (0.5, 0.95, 0.99))
    return out.select("day", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("language_distribution", "H7", f"WITH {EV} SELECT day, coalesce(lang, 'unknown') AS lang, count(*) AS n FROM ev LEFT JOIN documents d ON d.doc_id = ev.k GROUP BY ALL")
def language_distribution(spark, root):
    """Queries per day and language; unlabelled ones are unknown."""
    langs = table(spark, root, "documents").select(F.col("doc_id").alias("k"), "lang")
    joined = daily_questions(spark, root).join(langs, "k", "left")
    return joined.groupBy("day", F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.sum("n").alias("n"))


@query("active_users", "H8", f"WITH {EV} SELECT day, count(DISTINCT user_id) AS users FROM ev WHERE user_id % 10 <> 0 GROUP BY 1")
def active_users(spark, root):
    """Distinct users per day; every tenth user is anonymous and left out."""
    return events(spark, root).filter(F.pmod("user_id", F.lit(10)) != 0).groupBy("day").agg(F.count_distinct("user_id").alias("users"))


@query("daily_summary", "H9", rf"""WITH {EV}, {QUESTIONS}, {KW},
t AS (SELECT day, count(*) AS total, count(DISTINCT CASE WHEN user_id % 10 <> 0 THEN user_id END) AS users FROM ev GROUP BY 1),
i AS (SELECT day, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS intents FROM (SELECT day, event_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY 1),
w AS (SELECT day, string_agg(keyword || '=' || n, ',' ORDER BY rank) AS keywords FROM (SELECT day, keyword, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, keyword) AS rank FROM (SELECT day, keyword, count(*) AS n FROM ev JOIN kw USING (k) GROUP BY ALL)) WHERE rank <= 20 GROUP BY 1),
qc AS (SELECT day, md5(regexp_replace(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-?!.]', '', 'g')) AS query, count(*) AS n FROM ev JOIN qs USING (k) GROUP BY ALL),
q10 AS (SELECT day, string_agg(query || '=' || n, ',' ORDER BY rank) AS queries FROM (SELECT day, query, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, query) AS rank FROM qc) WHERE rank <= 10 GROUP BY 1)
SELECT t.day, total, users, intents, keywords, queries FROM t LEFT JOIN i USING (day) LEFT JOIN w USING (day) LEFT JOIN q10 USING (day)""")
def daily_summary(spark, root):
    """Summary of every day: total, users, intents, keywords, top queries."""
    ev = events(spark, root)
    totals = ev.groupBy("day").agg(F.count("*").alias("total"), F.count_distinct(F.when(F.pmod("user_id", F.lit(10)) != 0, F.col("user_id"))).alias("users"))

    def listed(ranked, name, out):
        # Ranked rows are at most 20 per day.
        rows = F.array_sort(F.collect_list(F.struct("rank", name, "n")))
        return ranked.groupBy("day").agg(F.array_join(F.transform(rows, lambda r: F.concat(r[name], F.lit("="), r["n"].cast("string"))), ",").alias(out))

    intents_, words = intent_distribution(spark, root), popular_keywords(spark, root)
    asked = listed(popular_queries(spark, root), "query", "queries")
    return (totals.join(listed(intents_, "intent", "intents"), "day", "left").join(listed(words, "keyword", "keywords"), "day", "left")
            .join(asked, "day", "left"))


CACHE = f"""{EV}, sets AS (SELECT k, sec AS cached_at, event_id, value FROM ev WHERE event_type IN ('view', 'signup', 'purchase')),
gets AS (SELECT event_id AS read_id, k, sec, value AS ms FROM ev WHERE event_type IN ('click', 'error')),
looked AS (SELECT read_id, k, sec, ms, max(CASE WHEN cached_at > sec - 7200 AND cached_at <= sec THEN (cached_at, event_id, value) END) AS w
  FROM gets LEFT JOIN (SELECT k, cached_at, event_id, value FROM sets) s USING (k) GROUP BY ALL)"""


def cache_reads(spark, root):
    ev = events(spark, root)
    writes = ev.filter(F.col("event_type").isin("view", "signup", "purchase")).select("k", "sec", F.col("event_id").alias("order"), "value")
    reads = ev.filter(F.col("event_type").isin("click", "error")).select(F.col("event_id").alias("read_id"), "k", "sec")
    return aggregates.latest_before(reads, writes, "k", "sec", 7200, "value")


@query("cache_lookup", "E15", f"WITH {CACHE} SELECT read_id, k, sec, w[1] AS cached_at, w[3] AS payload, w IS NOT NULL AS hit FROM looked")
def cache_lookup(spark, root):
    """Latest unexpired cache entry at the time of every read (two hours to live)."""
    return cache_reads(spark, root)


@query("cache_entries", "H10", f"""WITH {CACHE}, e AS (SELECT event_type AS kind, k, max(sec) AS sec FROM ev WHERE event_type IN ('view', 'signup', 'purchase') GROUP BY ALL)
SELECT kind, count(*) AS entries, sum(CASE WHEN sec > (SELECT max(sec) FROM ev) - 7200 THEN 1 ELSE 0 END)::BIGINT AS live FROM e GROUP BY 1""")
def cache_entries(spark, root):
    """Cache entries by kind: keys ever written, and those that have not expired by the last event."""
    ev = events(spark, root)
    last = ev.filter(F.col("event_type").isin("view", "signup", "purchase")).groupBy(F.col("event_type").alias("kind"), "k").agg(F.max("sec").alias("sec"))
    now = ev.agg(F.max("sec").alias("now")).select("now").scalar()
    return last.groupBy("kind").agg(F.count("*").alias("entries"), F.sum((F.col("sec") > now - 7200).cast("long")).alias("live"))


@query("cache_statistics", "H10 H11", f"""WITH {CACHE} SELECT CAST(to_timestamp(sec) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS reads, sum(CASE WHEN w IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS hits,
  round(avg(CASE WHEN w IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_rate, round(avg(CASE WHEN w IS NOT NULL THEN ms END), 6) AS hit_ms, round(avg(CASE WHEN w IS NULL THEN ms END), 6) AS miss_ms FROM looked GROUP BY 1""")
def cache_statistics(spark, root):
    """Hit rate and latency of hits and misses per day."""
    reads = events(spark, root).select(F.col("event_id").alias("read_id"), "day", F.col("value").alias("ms"))
    looked = cache_reads(spark, root).select("read_id", "hit").join(reads, "read_id")
    return looked.groupBy("day").agg(
        F.count("*").alias("reads"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 9).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("hit"), F.col("ms"))), 6).alias("hit_ms"), F.round(F.avg(F.when(~F.col("hit"), F.col("ms"))), 6).alias("miss_ms"))


@query("load_summary", "H12 H14", f"""WITH {EV} SELECT service, count(*) AS requests, sum(is_error::INT)::BIGINT AS failures, round(100.0::DOUBLE * (count(*) - sum(is_error::INT)) / count(*), 6) AS success_pct, round(avg(value), 6) AS mean_ms,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*)::DOUBLE / (max(sec) - min(sec)), 9) AS rps,
  count(DISTINCT event_id) = count(*) AS ids_unique, 1 - avg(is_error::INT) > 0.9 AS gate FROM ev GROUP BY 1""")
def load_summary(spark, root):
    """Load report per service: counts, success, latencies, rate and gates."""
    ev = events(spark, root)
    base = ev.groupBy("service").agg(
        F.count("*").alias("requests"), F.sum(F.col("is_error").cast("long")).alias("failures"), F.round(F.avg("value"), 6).alias("mean_ms"),
        stable(F.count("*") / (F.max("sec") - F.min("sec"))).alias("rps"), (1 - F.avg(F.col("is_error").cast("int")) > 0.9).alias("gate"))
    # Ids are unique if no id occurs twice; the repeats are found by a combining aggregate.
    repeats = ev.groupBy("service", "event_id").agg(F.count("*").alias("c")).groupBy("service").agg((F.max("c") == 1).alias("ids_unique"))
    tails = aggregates.percentiles(ev, ["service"], "value", (0.5, 0.95, 0.99)).drop("n")
    return base.join(tails, "service").join(repeats, "service").withColumns({
        "success_pct": F.round(100.0 * (F.col("requests") - F.col("failures")) / F.col("requests"), 6), **{c: F.round(c, 6) for c in ("p50", "p95", "p99")}})


@query("score_statistics", "H13", f"""WITH {sql.bm25()}, {CANDIDATES}, {OVERLAP} SELECT query_id, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS low, max(score) AS high,
  CASE WHEN stddev_pop(overlap) > 1e-9 THEN round(corr(score, overlap), 6) END AS correlation FROM ov GROUP BY 1""")
def score_statistics(spark, root):
    """Mean, deviation, range of every score list and its correlation with word overlap."""
    scored = sparse.overlap_scores(queries_of(spark, root), candidates(spark, root))
    # corr() ends the job where all scores of a list are equal; as in the SQL such a list has no number
    both = F.when(F.col("overlap").isNotNull(), F.col("score"))  # a candidate without overlap (no text) counts elsewhere only
    correlation = F.when(F.min(both) == F.max(both), float("nan")).otherwise(
        F.round(F.try_divide(F.covar_pop(both, F.col("overlap")), F.stddev_pop(both) * F.stddev_pop("overlap")), 6))
    return scored.groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("low"),
        F.max("score").alias("high"), F.when(F.stddev_pop("overlap") > 1e-9, correlation).alias("correlation"))


AUDIT_TYPES = {"signup": ("login_success", "success"), "error": ("login_failure", "failure"), "view": ("query_submitted", "submitted"), "click": ("access_granted", "granted"), "purchase": ("api_key_used", "success")}
AUDIT = f"""{EV}, au AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in AUDIT_TYPES.items())} END AS audit_type,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in AUDIT_TYPES.items())} END AS status FROM ev)"""


def audit(ev):
    """Events as audit records: type and status of each event type."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in AUDIT_TYPES.items() for x in (k, v[i])])[F.col("event_type")]
    return ev.withColumns({"audit_type": pick(0), "status": pick(1)})


@query("audit_summary", "H15", f"""WITH {AUDIT} SELECT coalesce(audit_type, 'all') AS audit_type, coalesce(status, 'all') AS status, count(*) AS n, count(DISTINCT user_id) AS users,
  sum(CASE WHEN audit_type = 'login_failure' AND value > 100 THEN 1 ELSE 0 END)::BIGINT AS suspicious FROM au GROUP BY GROUPING SETS ((audit_type), (status), ())""")
def audit_summary(spark, root):
    """Audit counts by type, by status and overall."""
    grouped = audit(events(spark, root)).groupingSets([["audit_type"], ["status"], []], "audit_type", "status").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"),
        F.sum(F.when((F.col("event_type") == "error") & (F.col("value") > 100), 1).otherwise(0)).alias("suspicious"))
    return grouped.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("audit_type", "status")})


@query("failed_logins", "H15", f"WITH {AUDIT} SELECT user_id, count(*) AS failures, max(sec) AS last_sec FROM au WHERE audit_type = 'login_failure' GROUP BY 1 HAVING count(*) >= 3")
def failed_logins(spark, root):
    """Users with at least three failed log-ins."""
    return audit(events(spark, root)).filter("audit_type = 'login_failure'").groupBy("user_id").agg(
        F.count("*").alias("failures"), F.max("sec").alias("last_sec")).filter("failures >= 3")


@query("session_table", "H16 J9", f"WITH {EV} SELECT user_id, k AS session_id, min(sec) AS started, max(sec) AS ended, count(*) AS query_count FROM ev GROUP BY ALL")
def session_table(spark, root):
    """Sessions by their explicit id."""
    return events(spark, root).groupBy("user_id", F.col("k").alias("session_id")).agg(
        F.min("sec").alias("started"), F.max("sec").alias("ended"), F.count("*").alias("query_count"))


STAR = f"""{sql.bm25()}, r AS ({sql.ranked('scores', 10)})"""


@query("feedback_by_rank", "H17 E16", f"""WITH {STAR} SELECT rank, count(*) AS shown, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS helpful, round(avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS used
FROM r JOIN labels USING (doc_id) GROUP BY 1""")
def feedback_by_rank(spark, root):
    """Share of helpful and used results per rank; labels stand for feedback."""
    run = corpus_index(spark, root).search(queries_of(spark, root), 10)
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 9)
    return run.join(table(spark, root, "labels"), "doc_id").groupBy("rank").agg(
        F.count("*").alias("shown"), share(F.col("quality") == 1).alias("helpful"), share(F.col("toxic") == 0).alias("used"))


@query("result_star_join", "E16", f"""WITH {STAR} SELECT query_id, doc_id, rank, score, md5(b.text) AS question, d.lang, d.source, coalesce(l.quality, -1) AS feedback FROM r JOIN benchmark b ON b.item_id = query_id
JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def result_star_join(spark, root):
    """Results with their query, document and feedback."""
    run = corpus_index(spark, root).search(queries_of(spark, root), 10)
    asked = queries_of(spark, root).select("query_id", F.md5("text").alias("question"))
    docs = table(spark, root, "documents").select("doc_id", "lang", "source")
    feedback = table(spark, root, "labels").select("doc_id", "quality")
    joined = run.join(asked, "query_id").join(docs, "doc_id").join(feedback, "doc_id", "left")
    return joined.select("query_id", "doc_id", "rank", "score", "question", "lang", "source", F.coalesce("quality", F.lit(-1)).alias("feedback"))


@query("conversation_rollup", "H22", """SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, sum(len(text))::BIGINT AS n_chars, sum((role = 'user')::INT)::BIGINT AS questions,
  arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1""")
def conversation_rollup(spark, root):
    """Messages, size, questions and first and last speaker of every conversation."""
    return table(spark, root, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"),
        F.sum((F.col("role") == "user").cast("long")).alias("questions"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"))


@query("session_titles", "G11", """WITH t AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN len(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS title FROM t ORDER BY conv_id DESC LIMIT 50""")
def session_titles(spark, root):
    """Fifty newest chat sessions with a title from their first question."""
    title = F.when(F.length("text") > 50, F.concat(F.substring("text", 1, 47), F.lit("..."))).otherwise(F.col("text"))
    return questions(spark, root).select(F.col("k").alias("conv_id"), title.alias("title")).orderBy(F.col("conv_id").desc()).limit(50)


@query("user_history", "G10 E18", f"""WITH {EV}, {QUESTIONS}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rank FROM ev)
SELECT user_id, event_id, rank, sec, md5(text) AS question FROM h JOIN qs USING (k) WHERE rank <= 10""")
def user_history(spark, root, kept_rows=1000, shown=10):
    """Latest queries per user of those kept, with their details; missing details are skipped."""
    kept = top_k(events(spark, root).select("user_id", "event_id", "us", "sec", "k"), ["user_id"], [F.col("us").desc(), F.col("event_id").desc()], kept_rows)
    details = questions(spark, root).select("k", F.md5("text").alias("question"))
    return kept.filter(F.col("rank") <= shown).join(details, "k").select("user_id", "event_id", "rank", "sec", "question")


@query("retained_history", "A20 J7", f"WITH {EV} SELECT event_id, day FROM ev WHERE us >= (SELECT max(us) FROM ev) - 7 * 86400000000")
def retained_history(spark, root, days=7):
    """Log rows young enough to be kept; stores of history keep 30 days, of analytics 90."""
    ev = events(spark, root)
    newest = ev.agg(F.max("us")).scalar()
    return ev.filter(F.col("us") >= newest - days * 86400000000).select("event_id", "day")


@query("budget_cut", "G7", f"""WITH {sql.bm25()}, {CANDIDATES}, s AS (SELECT query_id, doc_id, rank, len(text) // 4 AS tokens, sum(len(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM cand)
SELECT query_id, doc_id, rank, tokens, total::BIGINT AS total FROM s WHERE total <= 4000""")
def budget_cut(spark, root):
    """Leading documents of every query that fit into 4000 tokens."""
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = candidates(spark, root).select("query_id", "doc_id", "rank", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    return sized.withColumn("total", F.sum("tokens").over(order)).filter("total <= 4000")


TOP3 = f"""{sql.bm25()}, t3 AS (SELECT r.query_id, r.doc_id, r.rank, r.score, source || ' ' || doc_id AS title, source, text FROM ({sql.ranked('scores', 3)}) r JOIN documents USING (doc_id))"""


def top3(spark, root):
    docs = table(spark, root, "documents").select("doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), "source", "text")
    return corpus_index(spark, root).search(queries_of(spark, root), 3).join(docs, "doc_id")


@query("prompt_context", "H23", f"""WITH {TOP3}, c AS (SELECT query_id, chr(10) || repeat('-', 80) || string_agg('Document ' || rank || ': ' || title || chr(10) || 'Source: ' || source || chr(10) ||
  'Relevance Score: ' || printf('%.3f', score) || chr(10) || 'Content:' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM t3 GROUP BY 1)
SELECT item_id AS query_id, len(coalesce(context, 'No context documents provided.')) AS n_chars, md5(coalesce(context, 'No context documents provided.')) AS digest FROM benchmark LEFT JOIN c ON c.query_id = item_id""")
def prompt_context(spark, root):
    """Context text of every query from its three best documents."""
    from corpusflow.operators.answers import context_text

    made = context_text(queries_of(spark, root), top3(spark, root))
    return made.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))



@query("rendered_answers", "H24 F15", f"""WITH {TOP3}, s AS (SELECT query_id, string_agg(rank || '. ' || title || ' - ' || source, chr(10) ORDER BY rank) AS plain, string_agg('<li>' || title || ' - ' || source || '</li>', chr(10) ORDER BY rank) AS items,
  array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM t3 GROUP BY 1)
SELECT query_id, sources, md5(text || chr(10) || chr(10) || '---' || chr(10) || '**Sources:**' || chr(10) || plain) AS markdown, md5('<div class="response">' || text || '</div>' || chr(10) || '<hr>' || chr(10) || '<div class="sources">' || chr(10) ||
  '<strong>Sources:</strong>' || chr(10) || '<ol>' || chr(10) || items || chr(10) || '</ol>' || chr(10) || '</div>') AS html, md5(text || chr(10) || chr(10) || 'Sources:' || chr(10) || plain) AS plain_text FROM s JOIN benchmark ON item_id = query_id""")
def rendered_answers(spark, root):
    """Answers with numbered sources as markdown, HTML and plain text, and their distinct sources."""
    from corpusflow.operators.answers import rendered

    answers = queries_of(spark, root).withColumnRenamed("text", "content")
    out = rendered(answers, top3(spark, root))
    return out.select("query_id", "sources", *[F.md5(c).alias(c) for c in ("markdown", "html", "plain_text")])


@query("chunk_pages", "E13 G12", f"""WITH {PAGE_TEXT}, pg AS (SELECT doc_id, page_no, start_pos AS ps, start_pos + len(t) AS pe FROM po), dl AS (SELECT doc_id, max(pe) AS total, count(*) AS pages FROM pg GROUP BY 1),
ch AS (SELECT doc_id, total, pages, unnest(range(0, total, 120)) AS cs FROM dl), ce AS (SELECT *, least(cs + CASE WHEN cs % 7 = 0 THEN 1 ELSE 120 END, total) AS ce FROM ch)
SELECT c.doc_id, cs, ce, coalesce(min(page_no), floor(cs::DOUBLE / any_value(total) * any_value(pages))::BIGINT + 1) AS page_no FROM ce c LEFT JOIN pg ON pg.doc_id = c.doc_id AND greatest(cs, ps) < least(ce, pe) GROUP BY c.doc_id, cs, ce""")
def chunk_pages(spark, root):
    """Page of every chunk of a conversation document; chunks between pages are placed by position."""
    pages = page_texts(spark, root).select("doc_id", "page_no", F.col("start_pos").alias("rs"), F.col("end_pos").alias("re"))
    totals = pages.groupBy("doc_id").agg(F.max("re").alias("total"), F.count("*").alias("pages"))
    chunks = totals.select("doc_id", "total", "pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(120).cast("long"))).alias("ls"))
    width = F.when(F.col("ls") % 7 == 0, 1).otherwise(120)
    chunks = chunks.withColumn("le", F.least(F.col("ls") + width, F.col("total")))
    first = aggregates.overlapping(chunks.select("doc_id", "ls", "le"), pages, "doc_id", 512).groupBy("doc_id", "ls").agg(F.min("page_no").alias("page_no"))
    guess = (F.floor(F.col("ls") / F.col("total") * F.col("pages")) + 1).cast("long")
    return chunks.join(first, ["doc_id", "ls"], "left").select(
        "doc_id", F.col("ls").alias("cs"), F.col("le").alias("ce"), F.coalesce("page_no", guess).alias("page_no"))
