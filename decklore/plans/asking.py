"""Questions at run time and their intake, over the supplied tables: events are questions of users, conversations sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklore.functions.text import page_label
from decklore.operators import ranking, runtime
from decklore.plans import search
from decklore.sources.tables import read_table
from decklore.streaming import intake

COMMANDS = [
    (-1, "Cho tôi xem slide 7 nhé"), (-2, "sang trang tiếp theo đi!"), (-3, "quay lại trang trước"), (-4, "trang đầu tiên"), (-5, "mở slide cuối cùng ạ"),
    (-6, "nói lại lần nữa"), (-7, "dừng ở đây"), (-8, "quit"), (-9, "chuyển sang trang số 99"), (-10, "trang 3 nói gì về lương?"), (-11, "q"), (-12, "  Trang   12 . "),
    (-13, "please stop"), (-14, "lùi lại slide vừa rồi nhé"),
]
POINTING = [(1, "bảng này là gì"), (2, "hình bên trái nói gì"), (3, "số bên phải là bao nhiêu"), (4, "tổng lương"), (5, "cái kia ở phía trên"), (6, "NÀY, bên TRÁI?")]
REPLIES = [
    ("Lương trả ngày 5 [slide 3]. Có thưởng. Xem thêm. Và nữa.", ["[3]", " 4 "]), ("", ["3"]), ("Không có nguồn.", []), ("Nguồn sai.", ["999999"]),
    ("Xem www.example.com nhé", ["3"]), ("Một câu (Trang 12).", ["[[5]]"]), (None, ["3"]), ("Không danh sách.", None),
]


def fastpath_commands(spark, d):
    turns = read_table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "text")
    asked = turns.unionByName(spark.createDataFrame(COMMANDS, "qid long, text string"))
    found = runtime.commands(asked, F.lit(5), F.lit(20))
    return found.select("qid", "command", "target", "action")


def query_expansion(spark, d):
    asked = spark.createDataFrame(POINTING, "qid long, q string")
    pages = search.documents(spark, d).select("doc_id", F.col("source").alias("title"), "text")
    both = pages.crossJoin(F.broadcast(asked))
    return both.select("doc_id", "qid", runtime.expanded(F.col("q"), F.col("title"), F.col("text"), F.reverse("text")).alias("q"))


def page_labels(spark, d):
    docs = search.documents(spark, d)
    first = F.get(F.split("text", "\n"), F.lit(0))
    return docs.select("doc_id", page_label(F.when(F.col("doc_id") % 3 == 0, F.col("source")), first).alias("label"))


def context_dedup(spark, d):
    sp, de = search.sparse(spark, d), search.dense(spark, d)
    pages = search.found_pages(spark, d, sp, de)
    hits = sp.join(pages, "id").groupBy("qid", "page").agg(F.min("rank").alias("pos"))
    de = de.join(pages, "id").groupBy("qid", "page").agg(F.min("rank").alias("pos"))
    current = search.questions(spark, d).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("page"))
    return runtime.contexts(hits.filter("pos <= 5"), de.filter("pos <= 5"), current, 4)


def grounding_check(spark, d):
    rows = [(i, t, r) for i, (t, r) in enumerate(REPLIES)]
    replies = spark.createDataFrame(rows, "r long, text string, refs array<string>")
    langs = search.documents(spark, d).groupBy("source").agg(F.sort_array(F.collect_set((F.col("doc_id") % 7).cast("string"))).alias("ids"))
    both = langs.crossJoin(F.broadcast(replies)).withColumn("qid", F.concat_ws("/", "source", "r"))
    return runtime.checked(both.select("qid", "text", "refs"), both.select("qid", "ids"))


def rate_limit(spark, d):
    kept = intake.rate_limited(read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 3600.0)
    return kept.select("user_id", "event_id")


def burst_coalesce(spark, d):
    found = intake.bursts(read_table(spark, d, "events"), ["user_id", "event_type"], 600)
    return found.select("user_id", "event_type", "first_ts", "last_id", "n")


def queue_priority(spark, d):
    events = read_table(spark, d, "events")
    last = events.agg(F.max("ts").alias("now"))
    age = (F.col("now").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 3600
    waiting = events.crossJoin(F.broadcast(last)).select(
        "event_type", F.col("event_id").alias("id"), F.col("ts").alias("arrived"), F.round(intake.priority(F.col("value"), F.round(age, 3), F.col("user_id") % 4 == 0), 6).alias("score")
    )
    return intake.queue(waiting, ["event_type"]).select("event_type", "pos", "id", "score")


def dedup_count(spark, d):
    docs = search.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    found = intake.duplicate_counts(docs, "text")
    return found.select(F.sha1(F.col("text_norm").cast("binary")).alias("text_key"), "dup_count", "first_id")


def session_pages(spark, d):
    move = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", -1).otherwise(0)
    return intake.session_pages(read_table(spark, d, "conversations").select("conv_id", "turn", move.alias("move")), 5)


STATES = ("presenting", "answering", "navigating", "paused", "escalated")


def interrupt_matrix(spark, d):
    """What each event does to a robot whose state goes by the user's number, with as many waiting as the event's number says."""
    kind = F.when(F.col("event_type").isin("click", "view"), "navigate").when(F.col("event_type") == "purchase", "meta").otherwise("question")
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("user_id") % 5).cast("int"))
    events = read_table(spark, d, "events").select(kind.alias("event"), state.alias("state"), (F.col("event_id") % 6).alias("waiting"))
    return intake.interrupts(events).groupBy("state", "event", "action").agg(F.count(F.lit(1)).alias("n"))


def resume_stacks(spark, d):
    state = F.when(F.col("role") == "user", "presenting").otherwise("answering")
    moves = read_table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", state.alias("state"), (F.length("text") % 40).alias("page"))
    return intake.resume_stack(moves).select("session", F.array_join(F.col("stack").cast("array<string>"), ",").alias("stack"))


def overdue_questions(spark, d):
    events = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("arrived"))
    last = events.agg(F.max("arrived").alias("now"))
    return intake.overdue(events.crossJoin(F.broadcast(last)), F.col("now"), 86400.0).filter("overdue").select("id")


def gate_replies(spark, d):
    """Navigation by questions that name their second page."""
    hits = search.hybrid(spark, d)
    return ranking.gate(hits, hits.filter("pos = 2").select("qid", "page"), 0.01).select("qid", "action", "candidates")


QUERIES = [
    fastpath_commands, query_expansion, page_labels, context_dedup, grounding_check, rate_limit, burst_coalesce, queue_priority, dedup_count,
    session_pages, interrupt_matrix, gate_replies, resume_stacks, overdue_questions,
]

_text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_rows = lambda rows: ", ".join(f"({i}, {_text(t)})" for i, t in rows)
_list = lambda v: "CAST(NULL AS VARCHAR[])" if v is None else "CAST([" + ", ".join(map(_text, v)) + "] AS VARCHAR[])"
_full = lambda p: f"regexp_full_match(t, '{p}')"
C = runtime.COMMANDS
_command = "CASE " + " ".join(f"WHEN {_full(p)} THEN '{k}'" for k, p in C.items()) + " END"
SQL = {
    "fastpath_commands": f"""WITH a AS (SELECT conv_id * 100 + turn AS qid, text FROM conversations UNION ALL SELECT * FROM (VALUES {_rows(COMMANDS)}) v(q, x)),
        c AS (SELECT qid, t, {_command} AS command FROM (SELECT qid, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM a)),
        g AS (SELECT qid, command, CASE command WHEN 'goto' THEN CAST(regexp_extract(t, '^(?:{C["goto"]})$', 1) AS INTEGER) WHEN 'next' THEN 6 WHEN 'prev' THEN 4
          WHEN 'first' THEN 1 WHEN 'last' THEN 20 END AS target FROM c)
        SELECT qid, command, target, CASE WHEN command IN ('repeat', 'stop') THEN 'meta' WHEN target BETWEEN 1 AND 20 THEN 'goto' WHEN command IS NOT NULL THEN 'ask_back' END AS action FROM g""",
    "query_expansion": f"""SELECT doc_id, qid, CASE WHEN regexp_matches(q, '(?i)(^|[^\\pL])(?:này|đây|kia|bên trái|bên phải|phía trên|phía dưới)($|[^\\pL])')
        THEN concat_ws(' ', q, source, CASE WHEN contains(lower(q), 'trái') THEN nullif(substr(text, 1, 160), '') WHEN contains(lower(q), 'phải') THEN nullif(substr(reverse(text), 1, 160), '') END)
        ELSE q END AS q FROM documents, (VALUES {_rows(POINTING)}) v(qid, q)""",
    "page_labels": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN l = '' THEN '(không có chữ)' WHEN length(l) > 48 THEN substr(l, 1, 48) || '…' ELSE l END AS label
        FROM (SELECT doc_id, source, trim(string_split(text, chr(10))[1], ' ') AS l FROM documents)""",
    "context_dedup": search.BOTH + """, q1 AS (SELECT qid, page, min(rank) AS pos, 0 AS src FROM sparse JOIN pg USING (id) GROUP BY ALL HAVING pos <= 5),
        q2 AS (SELECT qid, page, min(rank) AS pos, 1 AS src FROM dense JOIN pg USING (id) GROUP BY ALL HAVING pos <= 5),
        u AS (SELECT qid, page, min(src * 1000 + pos) AS o FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2) WHERE page <> 'src' || (qid % 20) GROUP BY ALL)
        SELECT qid, page, row_number() OVER (PARTITION BY qid ORDER BY o, page) AS ord FROM u QUALIFY ord <= 4""",
    "grounding_check": f"""WITH l AS (SELECT source, list_sort(list_distinct(list(CAST(doc_id % 7 AS VARCHAR)))) AS ids FROM documents GROUP BY source),
        r AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_text(t)}, {_list(x)})" for i, (t, x) in enumerate(REPLIES))}) v(r, text, refs)),
        c AS (SELECT source || '/' || r AS qid, ids, trim(regexp_replace(coalesce(text, ''), '(?i)\\s*[\\[(](?:slide|trang)\\s*\\d+[\\])]', '', 'g')) AS text,
          coalesce(list_transform(refs, lambda x: trim(trim(trim(x), '[]'))), []) AS refs FROM l, r),
        b AS (SELECT *, len(list_filter(list_distinct(refs), lambda x: NOT list_contains(ids, x))) AS n_bad FROM c),
        o AS (SELECT *, text <> '' AND len(refs) > 0 AND n_bad = 0 AND NOT regexp_matches(text, 'https?://|www\\.') AS ok FROM b)
        SELECT qid, CASE WHEN ok THEN 'answer' ELSE 'escalate' END AS action,
          CASE WHEN ok THEN array_to_string(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ') END AS text,
          array_to_string(refs, ',') AS refs, n_bad FROM o""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        a AS (SELECT user_id, event_id, ts AS last, i, true AS ok FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.ts - a.last >= INTERVAL 1 HOUR THEN e.ts ELSE a.last END, e.i, e.ts - a.last >= INTERVAL 1 HOUR
          FROM a JOIN e ON e.user_id = a.user_id AND e.i = a.i + 1)
        SELECT user_id, event_id FROM a WHERE ok""",
    "burst_coalesce": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
        b AS (SELECT *, sum(s) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM m)
        SELECT user_id, event_type, min(ts) AS first_ts, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM b GROUP BY user_id, event_type, burst""",
    "queue_priority": """WITH w AS (SELECT event_type, event_id AS id, ts, round(value * 1.0 + round(epoch((SELECT max(ts) FROM events) - ts) / 3600, 3) * 0.1
            + CASE WHEN user_id % 4 = 0 THEN 5.0 ELSE 0.0 END, 6) AS score FROM events),
        k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, id DESC) <= 20)
        SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, ts, id) AS pos, id, score FROM k""",
    "dedup_count": "SELECT sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_key, count(*) AS dup_count, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "session_pages": """WITH RECURSIVE t AS (SELECT conv_id, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN -1 ELSE 0 END AS move, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
          count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        s AS (SELECT conv_id, greatest(1, least(5, 1 + move)) AS page, i, n FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, greatest(1, least(5, s.page + t.move)), t.i, t.n FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1)
        SELECT conv_id, page AS last_page, n AS n_turns FROM s WHERE i = n""",
    "interrupt_matrix": """WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'navigate' WHEN event_type = 'purchase' THEN 'meta' ELSE 'question' END AS event,
          ['presenting', 'answering', 'navigating', 'paused', 'escalated'][user_id % 5 + 1] AS state, event_id % 6 AS waiting FROM events)
        SELECT state, event, CASE
            WHEN state = 'navigating' THEN 'wait_for_ack'
            WHEN state = 'paused' THEN 'handle'
            WHEN state = 'escalated' THEN 'queue'
            WHEN event = 'navigate' THEN 'interrupt'
            WHEN state = 'answering' THEN 'queue'
            WHEN event = 'meta' THEN 'apply'
            WHEN waiting > 3 THEN 'interrupt'
            ELSE 'wait_for_page' END AS action, count(*) AS n FROM e GROUP BY ALL""",
    "resume_stacks": """WITH p AS (SELECT conv_id, list(length(text) % 40 ORDER BY turn) FILTER (role = 'user') AS ps FROM conversations GROUP BY conv_id)
        SELECT conv_id AS session, CASE WHEN ps IS NULL THEN '' WHEN len(ps) <= 2 THEN array_to_string(ps, ',') ELSE ps[1] || ',' || ps[-1] END AS stack FROM p""",
    "overdue_questions": "SELECT event_id AS id FROM events WHERE (SELECT max(ts) FROM events) - ts > INTERVAL 1 DAY",
    "gate_replies": search.BOTH + """, h AS (SELECT * FROM hits WHERE mode = 'hybrid'), p1 AS (SELECT qid, page FROM h WHERE pos = 1)
        SELECT h.qid, 'ask_back' AS action, h.page || ',' || p1.page AS candidates FROM h JOIN p1 USING (qid) WHERE pos = 2""",
}
