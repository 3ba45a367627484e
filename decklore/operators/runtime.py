"""Questions at run time: commands, expansion, contexts, checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from decklore.functions.text import DEICTIC, SPOKEN_URL, without_citations

# The command grammar, as parts and whole patterns.
TAIL = r"(?:\s+(?:đi|nhé|nha|ạ|với|giúp|giùm|luôn))*\s*[.!?]*"
FOR_WHOM = r"(?:cho (?:tôi|mình|em) )?"
MOVE = (
    r"(?:xem |mở |sang |qua |tới |đến |về |lật (?:sang |tới |đến )?"
    r"|chuyển (?:sang |tới |đến )?|quay (?:lại |về )(?:trang |slide )?)?"
)
SHEET = r"(?:trang|slide)"
COMMANDS = {
    "goto": rf"{FOR_WHOM}{MOVE}{SHEET}\s*(?:số\s*)?(\d+){TAIL}",
    "next": rf"{FOR_WHOM}(?:sang |qua |tới )?{SHEET} (?:tiếp(?: theo)?|sau|kế(?: tiếp)?){TAIL}",
    "prev": rf"{FOR_WHOM}(?:quay (?:lại|về) |lùi (?:lại )?|về ){SHEET} (?:trước(?: đó)?|vừa rồi){TAIL}",
    "first": rf"{FOR_WHOM}{MOVE}{SHEET} đầu(?: tiên)?{TAIL}",
    "last": rf"{FOR_WHOM}{MOVE}{SHEET} cuối(?: cùng)?{TAIL}",
    "repeat": rf"(?:nói|nhắc|đọc|giảng) lại(?: trang này| lần nữa)?{TAIL}",
    "stop": rf"(?:dừng|thoát|kết thúc|nghỉ)(?: lại| thôi| ở đây)?{TAIL}|q|quit|exit",
}


def commands(questions: DataFrame, current: Column, n_pages: Column) -> DataFrame:
    """questions(qid, text) with command, target, action: the whole text is a command, or action is null and the question
    goes on to search."""
    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    command = F.coalesce(*[F.when(said.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in COMMANDS.items()])
    named = F.regexp_extract(said, f"^(?:{COMMANDS['goto']})$", 1).try_cast("int")
    target = (
        F.when(F.col("command") == "goto", named)
        .when(F.col("command") == "next", current + 1)
        .when(F.col("command") == "prev", current - 1)
        .when(F.col("command") == "first", F.lit(1))
        .when(F.col("command") == "last", n_pages)
    )
    inside = F.col("target").between(F.lit(1), n_pages)
    action = (
        F.when(F.col("command").isin("repeat", "stop"), "meta")
        .when(F.col("command").isNotNull() & F.coalesce(inside, F.lit(False)), "goto")
        .when(F.col("command").isNotNull(), "ask_back")
    )
    return questions.withColumn("command", command).withColumn("target", target).withColumn("action", action)


def expanded(question: Column, title: Column, left: Column, right: Column) -> Column:
    """A question that points at the screen gets the page's title and the start of the block on the side it names."""
    q = F.lower(question)
    side = F.when(F.contains(q, F.lit("trái")), left).when(F.contains(q, F.lit("phải")), right)
    kept = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.when(question.rlike(DEICTIC), F.concat_ws(" ", question, kept(title), kept(F.substring(side, 1, 160)))).otherwise(question)


def contexts(qa: DataFrame, nav: DataFrame, current: DataFrame, most: int) -> DataFrame:
    """Hits (qid, page, pos) of both searches: answers first, then navigation, each page once, not the current one
    (qid, page); at most ``most``."""
    both = qa.select("qid", "page", "pos", F.lit(0).alias("src")).unionByName(nav.select("qid", "page", "pos", F.lit(1).alias("src")))
    best = both.join(current, ["qid", "page"], "left_anti").groupBy("qid", "page").agg(F.min(F.struct("src", "pos")).alias("o"))
    order = Window.partitionBy("qid").orderBy("o", "page")
    return best.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= most).select("qid", "page", "ord")


def checked(replies: DataFrame, valid: DataFrame, most_sentences: int = 3) -> DataFrame:
    """replies(qid, text, refs), valid(qid, ids): the action and text that may be spoken. An answer needs a text, sources,
    no unknown source and no address; it is cut to a few sentences."""
    clean = F.array_compact(F.transform("refs", lambda r: F.trim(F.btrim(F.trim(r), F.lit("[]")))))
    told = replies.join(valid, "qid", "left").withColumn("text", without_citations(F.coalesce("text", F.lit("")))).withColumn("refs", F.coalesce(clean, F.array().cast("array<string>")))
    bad = F.array_except("refs", F.coalesce("ids", F.array().cast("array<string>")))
    ok = (F.col("text") != "") & (F.size("refs") > 0) & (F.size(bad) == 0) & ~F.col("text").rlike(SPOKEN_URL)
    cut = F.array_join(F.slice(F.split("text", r"(?<=[.!?…])\s+"), 1, most_sentences), " ")
    return told.select(
        "qid",
        F.when(ok, "answer").otherwise("escalate").alias("action"),
        F.when(ok, cut).alias("text"),
        F.array_join("refs", ",").alias("refs"),
        F.size(bad).alias("n_bad"),
    )
