"""Chat formatting by quotation linking, in DataFrame operations only.

Lines are parsed into quote levels (the number of > before them). Quoted lines, and whole quoted passages of several
lines of one level, are normalised (lower case, white space folded) and hashed; so are the lines and the whole of what
each message says itself. A quoted unit comes from the latest earlier message of its conversation that says it, found
by one ordered pass over the units of a hash, so that a common line meets no product of its uses. A message answers
the message that most of its quoted characters of level one come from, the later one at ties. Messages that answer
none stand in the order of their turns, answers follow what they answer, and quotes and the lines that announce them
are taken out.

Cases: rows without conv_id or turn are left out; of rows that share both, the least by role and text counts. A null
text is empty, a null role is 'unknown'. A quote without a source is taken out like any other. A message of quotes
alone is kept with an empty body. Long conversations are numbered in parts; a chain of n answers stores n * n / 2 turn
numbers, since an order of replies is an order of paths. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read

#: A line that announces a quote, if one follows.
ANNOUNCES = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)[^:]*:[ \t]*$"
BREAK = r"\r\n|\n|\r"
#: Turns of first messages that are numbered together.
TURNS = 4096


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def parsed(text: Column) -> Column:
    """Lines as (level, body)."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^[ \t]*((?:>[ \t]*)*)", 1)
        level = (F.length(marks) - F.length(F.replace(marks, F.lit(">")))).cast("int")
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, r"^[ \t]*(?:>[ \t]*)+", "")).otherwise(x).alias("body"))

    return F.transform(F.split(text, BREAK), line)


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, own (what the message says itself, line by line), body, quotes."""
    one = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    rows = one.select("conv_id", "turn", "m.role", parsed(F.col("m.text")).alias("lines"))
    announced = lambda x, i: x["body"].rlike(ANNOUNCES) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)
    rows = rows.withColumn("own", F.transform(F.filter("lines", lambda x, i: (x["level"] == 0) & ~announced(x, i)), lambda x: x["body"]))
    body = F.regexp_replace(F.array_join("own", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return rows.withColumn("body", F.regexp_replace(body, r"\n[ \t]*\n[ \t\n]*\n", "\n\n")).withColumn("quotes", F.size(F.filter("lines", lambda x: x["level"] > 0)))


def quoted_units(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, at, unit: quoted lines, and passages of more than one line."""
    lines = rows.where("quotes > 0").select("conv_id", "turn", F.posexplode("lines").alias("at", "line")).select("conv_id", "turn", "at", "line.level", "line.body").where("level > 0")
    within = Window.partitionBy("conv_id", "turn", "level").orderBy("at")
    runs = lines.withColumn("run", F.col("at") - F.row_number().over(within)).groupBy("conv_id", "turn", "level", "run").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    passages = runs.where("n > 1").select("conv_id", "turn", "level", F.col("at"), normal(F.array_join(F.transform("parts", lambda x: x["body"]), " ")).alias("unit"))
    single = lines.select("conv_id", "turn", "level", "at", normal(F.col("body")).alias("unit"))
    return single.withColumn("whole", F.lit(False)).unionByName(passages.withColumn("whole", F.lit(True))).where("unit <> ''")


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked: the message that each quoting message answers, and its quoted lines with a source."""
    quotes = quoted_units(rows).withColumn("hash", F.md5("unit"))
    talks = rows.where("quotes > 0").select("conv_id").distinct()
    said = F.array_distinct(F.concat(F.transform("own", normal), F.array(normal(F.col("body")))))
    origins = rows.join(talks, "conv_id", "left_semi").select("conv_id", "turn", F.explode(said).alias("unit")).where("unit <> ''").select("conv_id", "turn", F.md5("unit").alias("hash"))
    both = origins.withColumn("kind", F.lit(1)).unionByName(quotes.withColumn("size", F.length("unit")).drop("unit").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("conv_id", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("source", F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(so_far)).where("kind = 0 AND source IS NOT NULL")
    # A quoted line has one source, so that lines add up over sources: one pass, without a join of found with itself.
    by_source = found.groupBy("conv_id", "turn", "source").agg(F.sum(F.when(F.col("level") == 1, F.col("size"))).alias("size"), F.count_if(~F.col("whole")).alias("lines"))
    best = F.max(F.when(F.col("size").isNotNull(), F.struct("size", "source")))
    return by_source.groupBy("conv_id", "turn").agg(F.sum("lines").alias("n_linked"), best.alias("b")).select("conv_id", "turn", "n_linked", F.col("b.source").alias("reply_to"))


def paths(links: DataFrame) -> DataFrame:
    """conv_id, turn, path (the turns from the first message of the thread down to this one). Paths double in length
    each round, so there are as many rounds as the logarithm of the longest chain of answers."""
    state = materialize(links.where("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("top"), F.array("reply_to", "turn").alias("path")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("head"))
        joined = materialize(state.join(above, ["conv_id", "top"], "left"))
        if joined.where("next IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", "path")
        longer = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("head", F.slice("path", 2, F.size("path"))))
        state = joined.select("conv_id", "turn", F.coalesce("next", "top").alias("top"), longer.alias("path"))


def formatted(turns: DataFrame) -> DataFrame:
    """A row for each message, in reply order: conv_id, position, turn, role, reply_to, depth, n_quoted and n_linked
    (lines), body without quotes, and chat, the message as a chat template writes it."""
    rows = messages(turns)
    links = materialize(linked(rows))
    order = rows.join(links, ["conv_id", "turn"], "left").join(paths(links), ["conv_id", "turn"], "left")
    order = order.withColumn("_path", F.coalesce("path", F.array("turn"))).withColumn("_part", F.floor(F.get("_path", F.lit(0)) / TURNS))
    # A long conversation is numbered in parts, by the turns of its threads' first messages.
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = order.groupBy("conv_id", "_part").agg(F.count("*").alias("_n")).select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy("_path"))
    numbered = order.withColumn("_at", within).join(firsts, ["conv_id", "_part"])
    return numbered.select("conv_id", (F.col("_first") + F.col("_at")).cast("int").alias("position"), "turn", "role", "reply_to", (F.size("_path") - 1).alias("depth"), F.col("quotes").alias("n_quoted"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "body", F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("body"), F.lit("<|im_end|>\n")).alias("chat"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation in reply order."""
    return formatted(read(spark, sf_dir, "conversations"))


def chat_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations made to quote: two turns of three cite the one before, one of them with the one before that nested
    in it, and all end with the same line."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    marked = lambda marks, text: F.concat(F.lit(marks), F.regexp_replace(text, "\n", f"\n{marks}"), F.lit("\n"))
    rows = read(spark, sf_dir, "conversations").withColumns({"_a": F.lag("text").over(by_turn), "_b": F.lag("text", 2).over(by_turn)})
    third = F.pmod("turn", F.lit(3))
    quote = F.when((third == 1) & F.col("_a").isNotNull(), F.concat(F.lit("In their last message the user wrote this, which I cite in full so that nothing of it is lost:\n"), marked("> ", F.col("_a"))))
    quote = quote.when((third == 2) & F.col("_b").isNotNull(), F.concat(marked("> > ", F.col("_b")), marked("> ", F.col("_a"))))
    return formatted(rows.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), "text", F.lit("\nThanks")).alias("text")))


ORACLE = r"""
WITH RECURSIVE one AS (
  SELECT conv_id, turn, min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS m
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), cut AS (
  SELECT conv_id, turn, m.role AS role, string_split_regex(m.text, '\r\n|\n|\r') AS raw FROM one
), lines AS (
  SELECT conv_id, turn, pos, raw[pos] AS x,
    length(regexp_extract(raw[pos], '^[ \t]*((?:>[ \t]*)*)', 1)) - length(replace(regexp_extract(raw[pos], '^[ \t]*((?:>[ \t]*)*)', 1), '>', '')) AS level
  FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS pos FROM cut)
), bodies AS (
  SELECT *, CASE WHEN level > 0 THEN regexp_replace(x, '^[ \t]*(?:>[ \t]*)+', '') ELSE x END AS line,
    lead(level, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS next_level
  FROM lines
), own AS (
  SELECT conv_id, turn, pos, line FROM bodies
  WHERE level = 0 AND NOT (next_level > 0 AND regexp_matches(line, '(?i)(wrote|writes|said|schrieb|a écrit|escribió)[^:]*:[ \t]*$'))
), body AS (
  SELECT c.conv_id, c.turn, c.role,
    regexp_replace(regexp_replace(coalesce(o.t, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '\n[ \t]*\n[ \t\n]*\n', E'\n\n', 'g') AS body
  FROM cut c LEFT JOIN (SELECT conv_id, turn, string_agg(line, E'\n' ORDER BY pos) AS t FROM own GROUP BY ALL) o USING (conv_id, turn)
), said AS (
  SELECT DISTINCT conv_id, turn, unit FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g')) AS unit FROM own
    UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(body), '[ \t\r\n]+', ' ', 'g')) FROM body)
  WHERE unit <> ''
), quoted AS (
  SELECT conv_id, turn, pos, level, line, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM bodies WHERE level > 0
), units AS (
  SELECT conv_id, turn, level, pos, FALSE AS whole, trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g')) AS unit FROM quoted
  UNION ALL
  SELECT conv_id, turn, level, min(pos), TRUE, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY pos)), '[ \t\r\n]+', ' ', 'g'))
  FROM quoted GROUP BY conv_id, turn, level, run HAVING count(*) > 1
), found AS (
  SELECT u.*, (SELECT max(s.turn) FROM said s WHERE s.conv_id = u.conv_id AND s.unit = u.unit AND s.turn < u.turn) AS source
  FROM units u WHERE unit <> ''
), linked AS (
  SELECT conv_id, turn, count(DISTINCT CASE WHEN NOT whole THEN pos END) AS n_linked FROM found WHERE source IS NOT NULL GROUP BY ALL
), best AS (
  SELECT conv_id, turn, max({'size': size, 'source': source}).source AS reply_to
  FROM (SELECT conv_id, turn, source, sum(length(unit)) AS size FROM found WHERE level = 1 AND source IS NOT NULL GROUP BY ALL) GROUP BY conv_id, turn
), walk AS (
  SELECT b.conv_id, b.turn, [b.turn] AS path FROM body b LEFT JOIN best USING (conv_id, turn) WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, list_append(w.path, r.turn) FROM best r JOIN walk w ON w.conv_id = r.conv_id AND w.turn = r.reply_to
)
SELECT b.conv_id, CAST(row_number() OVER (PARTITION BY b.conv_id ORDER BY w.path) AS INTEGER) AS position, b.turn, b.role, best.reply_to,
  CAST(len(w.path) - 1 AS INTEGER) AS depth,
  CAST((SELECT count(*) FROM quoted q WHERE q.conv_id = b.conv_id AND q.turn = b.turn) AS INTEGER) AS n_quoted,
  coalesce(l.n_linked, 0) AS n_linked, b.body, '<|im_start|>' || b.role || E'\n' || b.body || E'<|im_end|>\n' AS chat
FROM body b JOIN walk w USING (conv_id, turn) LEFT JOIN linked l USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn)
"""

QUOTED_ORACLE = ORACLE.replace("FROM conversations WHERE", "FROM talk WHERE").replace(
    "WITH RECURSIVE one AS (",
    """WITH RECURSIVE near AS (SELECT *, lag(text) OVER w AS a, lag(text, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
talk AS (
  SELECT conv_id, turn, role, CASE
    WHEN turn % 3 = 1 AND a IS NOT NULL THEN E'In their last message the user wrote this, which I cite in full so that nothing of it is lost:\n> ' || replace(a, E'\n', E'\n> ') || E'\n'
    WHEN turn % 3 = 2 AND b IS NOT NULL THEN '> > ' || replace(b, E'\n', E'\n> > ') || E'\n> ' || replace(a, E'\n', E'\n> ') || E'\n'
    ELSE '' END || text || E'\nThanks' AS text
  FROM near
), one AS (""",
)
