r"""Chat formatting by quotation linking.  DataFrame functions only.

A line's quote level is the number of ``>`` before its text (blanks between them allowed).  Consecutive lines of one level are a
passage; an attribution line (``On ... wrote:``) right before a deeper passage goes with it.  Quoted passages are
hashed in normalised form (lower case, white space runs as one space, trimmed) and joined to the first message of the
conversation that says the same by itself: as its whole text, or as a block between blank lines, or as a line; a
passage that no earlier message says so is joined to the first one that has it as a run of whole lines, however the quote
is wrapped (partial quotes of more than one line; SQL lacks this step, so the two differ where there are such quotes).
A message replies to the original of its outermost quoted passage that has one (the latest turn among several of
one level); with none, to the turn before it.  The first reply to a message continues its branch, a later one opens a
branch of its own; a conversation reads branch by branch, by turn within a branch, so that replies follow what
they reply to, and texts no longer hold the quotes.

Work is by row, and by (conversation, hash) with pre-aggregated minima: a conversation of any size is never gathered in one
task.  Turns before others are found within blocks of turns, then across blocks.

Defined results: null or empty text stays so, with no quotes.  A null conv_id or turn: the row keeps its text without
quotes, and has no parent or branch.  Rows with one (conv_id, turn) are one message of several texts: they share
parent and branch.  A message of quotes only becomes an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

MARK = r"^[ \t]*>[ \t>]*"
ATTRIBUTION = r"^[ \t]*On [^\n]{1,200} wrote:[ \t\r]*$"
#: Numbers of first words by which a partial quote finds the lines that it may begin with.
ANCHORS = (1, 2, 4, 8)
#: Turns a block holds.
BLOCK = 256


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, body>>: runs of lines of one quote level, without their marks."""
    lines = F.split(text, "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), r"[ \t]", ""))
    marked = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("body")))
    # an attribution takes the level of what it introduces
    follows = lambda i: F.get(marked, i + 1)
    marked = F.transform(marked, lambda x, i: F.when((x["level"] < F.coalesce(follows(i)["level"], F.lit(0))) & x["body"].rlike(ATTRIBUTION), F.struct(follows(i)["level"].alias("level"), F.lit(None).cast("string").alias("body"))).otherwise(x))
    none = F.expr("cast(array() as array<struct<level:int,body:string>>)")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(x["level"].alias("level"), F.when(last["body"].isNull(), x["body"]).when(x["body"].isNull(), last["body"]).otherwise(F.concat(last["body"], F.lit("\n"), x["body"])).alias("body"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["level"] == x["level"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(marked, none, add)


def runs(left: DataFrame, said: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, hash, turn): messages of said (conv_id, turn, text) that have a passage of left (conv_id, hash, norm) as a run of lines."""
    left = left.select("conv_id", "hash", "norm").distinct().withColumn("words", F.split("norm", " "))
    k = F.coalesce(*(F.when(F.size("words") >= n, n) for n in reversed(ANCHORS)))
    left = left.select("conv_id", "hash", "norm", F.size("words").alias("n"), F.xxhash64(k, F.array_join(F.slice("words", 1, k), " ")).alias("anchor"))
    lines = F.filter(F.transform(F.split("text", "\n"), normal), lambda x: x != "")
    texts = said.join(left.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.xxhash64("text").alias("key"), lines.alias("lines")).where("size(lines) > 0")
    texts = scratch.save(texts.dropDuplicates(["conv_id", "turn", "key"]))
    # lines' beginnings without their texts, which only those that a passage may begin with fetch again
    ahead = lambda i: F.split(F.array_join(F.slice("lines", i, max(ANCHORS)), " "), " ")
    begins = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct(i.alias("i"), ahead(i).alias("w")))
    begins = texts.select("conv_id", "turn", "key", F.explode(begins).alias("b")).select("conv_id", "turn", "key", "b.i", F.explode(F.array(*(F.xxhash64(F.lit(n), F.array_join(F.slice("b.w", 1, n), " ")) for n in ANCHORS))).alias("anchor"))
    got = begins.distinct().join(left, ["conv_id", "anchor"]).join(texts, ["conv_id", "turn", "key"])
    run = F.concat(F.array_join(F.slice("lines", F.col("i"), F.col("n")), "\n"), F.lit("\n"))  # n words stand in n lines at most
    same = (F.substr(F.translate(run, "\n", " "), F.lit(1), F.length("norm")) == F.col("norm")) & (F.substr(run, F.length("norm") + 1, F.lit(1)) == "\n")
    return got.where(same).select("conv_id", "hash", "turn")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, branch, n_quoted, n_linked, formatted), a row for each message row."""
    scratch = Scratch(messages.sparkSession, "quotes")
    m = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("raw"))
    quoting = F.coalesce(F.col("raw").rlike("(?m)" + MARK), F.lit(False))
    plain = m.where(~quoting).withColumn("quoted", F.expr("cast(array() as array<struct<level:int,hash:string,norm:string>>)")).withColumn("text", F.col("raw"))
    parsed = m.where(quoting).withColumn("parts", passages(F.col("raw")))
    own = F.array_join(F.transform(F.filter("parts", lambda p: (p["level"] == 0) & p["body"].isNotNull()), lambda p: p["body"]), "\n")
    hashes = F.transform(F.filter("parts", lambda p: (p["level"] > 0) & (normal(p["body"]) != "")), lambda p: F.struct(p["level"].alias("level"), F.md5(normal(p["body"]).cast("binary")).alias("hash"), normal(p["body"]).alias("norm")))
    parsed = parsed.withColumn("quoted", hashes).withColumn("text", F.trim(own, F.lit(" \t\r\n"))).drop("parts")
    said = scratch.save(plain.unionByName(parsed).drop("raw"))

    where = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quotes = scratch.save(said.where(where & (F.size("quoted") > 0)).select("conv_id", "turn", F.explode(F.array_distinct("quoted")).alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.norm"))
    convs = quotes.select("conv_id").distinct()
    # only conversations with quotes need an index of what was said; semi join before the texts are cut
    speech = said.join(convs, "conv_id", "left_semi").where(where)
    pieces = F.array_union(F.array("text"), F.array_union(F.split("text", r"\n[ \t\r]*\n"), F.split("text", "\n")))
    index = speech.select("conv_id", "turn", F.explode(pieces).alias("piece")).withColumn("n", normal(F.col("piece"))).where("n != ''")
    index = index.groupBy("conv_id", F.md5(F.col("n").cast("binary")).alias("hash")).agg(F.min("turn").alias("origin"))
    found = quotes.join(index, ["conv_id", "hash"]).where("origin < turn").select("conv_id", "turn", "level", "hash", "origin")
    if not quotes.isEmpty():
        found = scratch.save(found)
        left = scratch.save(quotes.join(found.select("conv_id", "turn", "hash"), ["conv_id", "turn", "hash"], "left_anti"))
        if not left.isEmpty():
            begun = runs(left, speech, scratch).groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
            found = found.unionByName(left.join(begun, ["conv_id", "hash"]).where("origin < turn").select("conv_id", "turn", "level", "hash", "origin"))
    linked = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("origin"))).alias("best"), F.count_distinct("hash").alias("n_linked"))
    linked = scratch.save(linked.select("conv_id", "turn", (-F.col("best.col2")).alias("quoted_turn"), "n_linked"))

    # the turn before: within blocks of turns, and for a block's first turn the last of the block before
    turns = said.where(where).select("conv_id", "turn").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    ends = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    ends = ends.withColumn("earlier", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))).drop("last")
    before = F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    nodes = turns.withColumn("before", before).join(ends, ["conv_id", "block"]).withColumn("before", F.coalesce("before", "earlier"))
    nodes = nodes.join(linked, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"))
    nodes = scratch.save(nodes)
    # a first reply continues its parent's branch: follow such steps to the branch's start by pointer doubling
    first = nodes.where("parent_turn is not null").groupBy("conv_id", "parent_turn").agg(F.min("turn").alias("first"))
    firsts = scratch.save(first)
    step = nodes.select("conv_id", "turn", "parent_turn").join(firsts, ["conv_id", "parent_turn"], "left")
    split = firsts.groupBy("conv_id").agg(F.count("*").alias("parents")).join(nodes.where("parent_turn is not null").groupBy("conv_id").agg(F.count("*").alias("replies")), "conv_id").where("parents < replies").select("conv_id")
    forked = scratch.save(step.join(split, "conv_id", "left_semi").select("conv_id", "turn", F.when(F.col("turn") == F.col("first"), F.col("parent_turn")).otherwise(F.col("turn")).alias("up")))
    while True:
        over = forked.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"))
        jumped = scratch.save(forked.join(over, ["conv_id", "up"]).select("conv_id", "turn", "up", "upper"))
        if jumped.where("up != upper").isEmpty():
            break
        forked = jumped.select("conv_id", "turn", F.col("upper").alias("up"))
    heads = nodes.groupBy("conv_id").agg(F.min("turn").alias("head"))
    placed = nodes.join(forked, ["conv_id", "turn"], "left").join(heads, "conv_id").select("conv_id", "turn", "parent_turn", "n_linked", F.coalesce("up", "head").alias("branch"))
    out = said.join(placed, ["conv_id", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "branch", F.size("quoted").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), formatted.alias("formatted"))


def conversations(linked: DataFrame, part: int = 1_024) -> DataFrame:
    """(conv_id, branch, part, reply_to, turns, n_messages, n_quoted, n_linked, formatted): the reading text of each branch.

    Messages stand by turn; a branch of more than ``part`` messages goes on in further parts, so that no row is unbounded.
    reply_to is the turn that the part's first message answers.  Messages without conversation or turn are rows by themselves.
    """
    rows = linked.where("branch is not null").withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "branch", "block"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id", "branch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("turn", "role", "formatted")))
    rows = rows.join(counts.select(*key, F.coalesce(ahead, F.lit(0)).alias("ahead")), key)
    rows = rows.withColumn("r", F.col("r") + F.col("ahead") - 1).withColumn("part", F.floor(F.col("r") / part))
    got = rows.groupBy("conv_id", "branch", "part").agg(F.array_sort(F.collect_list(F.struct("r", "turn", "parent_turn", "formatted"))).alias("m"), F.sum("n_quoted").alias("n_quoted"), F.sum("n_linked").alias("n_linked"))
    got = got.select("conv_id", "branch", "part", F.get("m.parent_turn", F.lit(0)).alias("reply_to"), F.array_join(F.transform("m.turn", lambda x: x.cast("string")), ",").alias("turns"), F.size("m").cast("long").alias("n_messages"), "n_quoted", "n_linked", F.array_join("m.formatted", "").alias("formatted"))
    none = F.lit(None).cast("long")
    loose = linked.where("branch is null").select("conv_id", none.alias("branch"), F.lit(0).cast("long").alias("part"), none.alias("reply_to"), F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turns"), F.lit(1).cast("long").alias("n_messages"), F.col("n_quoted").cast("long").alias("n_quoted"), F.col("n_linked").cast("long").alias("n_linked"), "formatted")
    return got.unionByName(loose)


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    linked = link_quotes(table(spark, sf_dir, "conversations"))
    return conversations(Scratch(spark, "conversations").save(linked))


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id, turn, role, text AS raw FROM conversations),
l0 AS (SELECT k, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM m WHERE raw IS NOT NULL),
l1 AS (SELECT k, i, length(regexp_replace(regexp_extract(line, '^[ \t]*>[ \t>]*'), '[ \t]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[ \t>]*', '') AS body FROM l0),
l2 AS (SELECT k, i, level, body, coalesce(lead(level) OVER (PARTITION BY k ORDER BY i), 0) AS nxt FROM l1),
l3 AS (SELECT k, i, CASE WHEN level < nxt AND regexp_matches(body, '^[ \t]*On [^\n]{1,200} wrote:[ \t\r]*$') THEN nxt ELSE level END AS level, CASE WHEN level < nxt AND regexp_matches(body, '^[ \t]*On [^\n]{1,200} wrote:[ \t\r]*$') THEN NULL ELSE body END AS body FROM l2),
l4 AS (SELECT *, i - row_number() OVER (PARTITION BY k, level ORDER BY i) AS run FROM l3),
p AS (SELECT k, level, run, min(i) AS i, string_agg(body, chr(10) ORDER BY i) AS body FROM l4 GROUP BY k, level, run),
n AS (SELECT k, level, i, body, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM p),
quoting AS (SELECT DISTINCT k FROM p WHERE level > 0),
own AS (SELECT k, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), E' \t\r\n') AS text FROM p WHERE k IN (FROM quoting) GROUP BY k),
said AS (SELECT m.k, conv_id, turn, role, CASE WHEN m.k IN (FROM quoting) THEN own.text ELSE raw END AS text, (SELECT count(*) FROM n WHERE n.k = m.k AND n.level > 0 AND n.norm <> '') AS n_quoted FROM m LEFT JOIN own ON own.k = m.k),
quotes AS (SELECT DISTINCT conv_id, turn, level, md5(norm) AS hash FROM n JOIN m USING (k) WHERE level > 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
pieces AS (SELECT conv_id, turn, text AS piece FROM said UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM said UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM said),
spoken AS (SELECT conv_id, turn, trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM pieces WHERE conv_id IN (SELECT conv_id FROM quotes)),
idx AS (SELECT conv_id, md5(norm) AS hash, min(turn) AS origin FROM spoken WHERE norm <> '' AND turn IS NOT NULL GROUP BY ALL),
found AS (SELECT q.conv_id, q.turn, q.level, q.hash, origin FROM quotes q JOIN idx ON q.conv_id = idx.conv_id AND q.hash = idx.hash WHERE origin < q.turn),
linked AS (SELECT conv_id, turn, arg_min(origin, level * 1000000000 - origin) AS quoted_turn, count(DISTINCT hash) AS n_linked FROM found GROUP BY ALL),
turns AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
nodes AS (SELECT t.conv_id, t.turn, coalesce(quoted_turn, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn)) AS parent_turn, coalesce(n_linked, 0) AS n_linked FROM turns t LEFT JOIN linked USING (conv_id, turn)),
step AS (SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id, parent_turn) THEN parent_turn END AS up FROM nodes),
branch AS (SELECT conv_id, turn, turn AS branch FROM step WHERE up IS NULL UNION ALL SELECT s.conv_id, s.turn, b.branch FROM step s JOIN branch b ON s.conv_id = b.conv_id AND s.up = b.turn)
, msg AS (SELECT s.conv_id, s.turn, s.role, parent_turn, branch, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
  '<|' || coalesce(s.role, 'unknown') || '|>' || chr(10) || coalesce(s.text, '') || chr(10) AS formatted
 FROM said s LEFT JOIN nodes USING (conv_id, turn) LEFT JOIN branch USING (conv_id, turn)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id, branch ORDER BY turn, role NULLS FIRST, formatted) - 1 AS r FROM msg WHERE branch IS NOT NULL)
SELECT conv_id, branch, r // 1024 AS part, list(parent_turn ORDER BY r)[1] AS reply_to, string_agg(turn, ',' ORDER BY r) AS turns, count(*) AS n_messages, CAST(sum(n_quoted) AS BIGINT) AS n_quoted, CAST(sum(n_linked) AS BIGINT) AS n_linked, string_agg(formatted, '' ORDER BY r) AS formatted
FROM num GROUP BY conv_id, branch, r // 1024
UNION ALL SELECT conv_id, NULL, 0, NULL, coalesce(CAST(turn AS VARCHAR), ''), 1, n_quoted, n_linked, formatted FROM msg WHERE branch IS NULL"""
