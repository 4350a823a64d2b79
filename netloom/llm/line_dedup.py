r"""Line dedup by a log-template tree, in DataFrame operations only.

A line is cut at white space; tokens with a digit or @ are variable fields and become <*>. Fixed-depth parsing
sends the line to the leaf of its token count and its LEAD leading tokens. A leaf has as many templates as its lines
need:

* every masked line is a template of its own;
* the leaf's model is the masked line that most documents have (of equals, the one of greatest MD5); lines that agree
  with it in SIMILAR tenths of the places or more are one template;
* lines that the model leaves over are generalised one place at a time: lines that are equal but for the token at one
  place behind the leading ones are one template, where such lines agree in SIMILAR tenths of the places.

A template that recurs in MIN_DOCS or more documents is dropped wherever it stands. Exact copies of a document count
once: documents are told apart by an MD5 of their whole text. Lines of fewer than LEAD tokens are leaves of their own.
Lines that are variable fields only stand for themselves if they have a letter, else they always stay.

Rows: a null text counts as empty; blank lines always stay;
repeated rows are judged alike; a null doc_id takes part; other columns are kept as they are; an empty table gives
no rows. Only \n ends a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import discard, materialize, spread_join

MIN_DOCS, LEAD, SIMILAR = 5, 3, 7
#: Places to drop go to all executors up to so many, else they are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000


def spaced(line: F.Column) -> F.Column:
    """The line with single spaces between its tokens."""
    marks = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\r", "\f", "\x0b")]
    uneven = marks[0] | marks[1] | marks[2] | marks[3] | marks[4]
    return F.trim(F.when(uneven, F.regexp_replace(line, "[\\t\\r\\f\\x0B ]+", " ")).otherwise(line))


def with_fields(spaced: F.Column) -> F.Column:
    """The line with <*> for variable fields."""
    return F.when(spaced.rlike("[0-9@]"), F.regexp_replace(spaced, "(?<![^ ])[^ ]*[0-9@][^ ]*", "<*>")).otherwise(spaced)


def masked(spaced: F.Column, fields: F.Column) -> F.Column:
    """The line as it stands for its template; null for lines that always stay."""
    own = F.when(spaced.rlike("\\p{L}"), spaced)
    return F.when(fields.isin("<*>", "<*> <*>"), own).when(fields != "", fields)


def with_key(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text have one key: they are judged alike."""
    return docs.withColumn("_key", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")))


def parsed(docs: DataFrame) -> DataFrame:
    """_key, doc (hash of the whole text), pos, n (tokens), masked, leaf, h of the lines that can be dropped."""
    # the hash is taken before the lines part, once a document; exploded arrays of one keep filters from repeating an expression
    once = lambda c: F.explode(F.array(c))
    lines = docs.select("_key", F.md5("text").alias("doc"), F.split(F.col("text"), "\n").alias("lines")).select("_key", "doc", F.posexplode_outer("lines").alias("pos", "line"))
    tidy = lines.select("_key", "doc", "pos", once(spaced(F.col("line"))).alias("spaced")).select("*", once(with_fields(F.col("spaced"))).alias("fields"))
    tidy = tidy.select("_key", "doc", "pos", masked(F.col("spaced"), F.col("fields")).alias("masked"))
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.concat_ws(" ", n.cast("string"), F.substring_index("masked", " ", LEAD))
    return tidy.where("masked IS NOT NULL").select("_key", "doc", "pos", n.alias("n"), "masked", leaf.alias("leaf"), F.md5("masked").alias("h"))


def _spread(kinds: DataFrame, by_line: DataFrame, min_docs: int) -> DataFrame:
    """kinds: h, template. The templates that min_docs or more documents have."""
    docs = by_line.join(kinds, "h").select("template", "doc").distinct()
    return docs.groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("template")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """_key, gone (array of line positions) of the rows that lose lines. docs has _key, doc_id and text."""
    lines = materialize(parsed(docs))
    seen = lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
    live = materialize(seen.where(F.col("docs") >= min_docs).select("leaf"))
    places = materialize(spread_join(lines.select("_key", "doc", "pos", "leaf", "h"), live, ["leaf"], "doc"))
    by_line = materialize(places.select("leaf", "h", "doc").distinct())
    texts = materialize(spread_join(lines.select("leaf", "h", "n", "masked"), live, ["leaf"], "h").groupBy("h").agg(F.min("masked").alias("masked"), F.min("n").alias("n")))
    kinds = materialize(by_line.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("docs")))
    discard(lines)
    model = kinds.groupBy("leaf").agg(F.max(F.struct("docs", "h")).alias("m")).select("leaf", F.col("m.h").alias("model"), F.col("m.docs").alias("model_docs"))
    model = materialize(model.join(texts.select(F.col("h").alias("model"), F.split("masked", " ").alias("model_tokens")), "model"))
    alike = spread_join(kinds.where(F.col("docs") < min_docs), model, ["leaf"], "h", "inner").join(texts, "h").withColumn("tokens", F.split("masked", " "))
    agree = F.size(F.filter(F.zip_with("tokens", "model_tokens", lambda a, b: a == b), lambda same: same))
    alike = materialize(alike.select("h", "docs", "n", "tokens", "model", "model_docs", (10 * agree >= SIMILAR * F.col("n")).alias("fits")))
    of_model = alike.where("fits").where(F.col("model_docs") < min_docs).select("h", F.col("model").alias("template"))
    # of the others, each place behind the leading tokens is a variable field in turn
    left = alike.where(~F.col("fits") & (10 * (F.col("n") - 1) >= SIMILAR * F.col("n")))
    # a line without the token of a place: the exclusive or of all tokens' hashes, each with its place, without that one's,
    # so that a place costs two numbers and not the line
    placed = lambda seed: F.transform("tokens", lambda t, i: F.xxhash64(F.lit(seed), i, t))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    hashed = left.select("h", "docs", "n", placed(1).alias("p"), placed(2).alias("q")).select("h", "docs", "n", "p", "q", whole("p").alias("x"), whole("q").alias("y"))
    one_less = hashed.select("h", "docs", "n", "x", "y", F.posexplode(F.slice(F.arrays_zip("p", "q"), LEAD + 1, F.col("n"))).alias("place", "v"))
    template = F.concat_ws(" ", "n", "place", F.col("x").bitwiseXOR(F.col("v.p")), F.col("y").bitwiseXOR(F.col("v.q")))
    one_less = materialize(one_less.select("h", "docs", template.alias("template")))
    likely = one_less.groupBy("template").agg(F.sum("docs").alias("most")).where(F.col("most") >= min_docs).select("template")
    in_place = materialize(spread_join(one_less.select("h", "template"), materialize(likely), ["template"], "h"))
    bad = kinds.where(F.col("docs") >= min_docs).select("h").union(alike.where("fits").where(F.col("model_docs") >= min_docs).select("h"))
    for group in (of_model, in_place):
        bad = bad.union(spread_join(group, materialize(_spread(group, by_line, min_docs)), ["template"], "h").select("h"))
    bad = materialize(bad.distinct())
    gone = materialize(spread_join(places, bad, ["h"], "_key").groupBy("_key").agg(F.collect_set("pos").alias("gone")))
    for done in (live, places, by_line, texts, kinds, model, alike, one_less, in_place, bad):
        discard(done)
    return gone


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs, text without the dropped lines, and n_lines, n_dropped, which take the place of columns so named."""
    names = docs.columns
    keyed = with_key(docs)
    gone = dropped_lines(keyed.select("_key", "doc_id", "text"), min_docs).withColumnRenamed("gone", "_gone")
    places = gone.agg(F.sum(F.size("_gone")).alias("n")).first().n or 0
    # the texts stay where they are while the places to drop are few; else both sides are shuffled by the key
    joined = keyed.join(F.broadcast(gone) if places <= MAX_BROADCAST_ROWS else gone.hint("merge"), "_key", "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).alias("n_lines")
    n_dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_dropped")
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in names if c not in ("n_lines", "n_dropped")), n_lines, n_dropped)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row."""
    return dedup_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "n_lines", "n_dropped", "text")


#: The same in SQL for DuckDB.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS doc FROM documents),
lines AS (SELECT k, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
tidy AS (SELECT k, doc, pos, trim(regexp_replace(line, '[\t\r\f\x0B ]+', ' ', 'g'), ' ') AS spaced FROM lines),
fields AS (SELECT *, regexp_replace(spaced, '[^ ]*[0-9@][^ ]*', '<*>', 'g') AS f FROM tidy),
own AS (SELECT k, doc, pos, CASE WHEN f IN ('<*>', '<*> <*>') THEN CASE WHEN regexp_matches(spaced, '\p{L}') THEN spaced END WHEN f <> '' THEN f END AS masked FROM fields),
parsed AS (SELECT k, doc, pos, masked, string_split(masked, ' ') AS tokens, md5(masked) AS h FROM own WHERE masked IS NOT NULL),
leaved AS (SELECT k, doc, pos, masked, h, len(tokens) AS n, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM parsed),
live AS (SELECT leaf FROM leaved GROUP BY leaf HAVING count(DISTINCT doc) >= 5),
places AS (SELECT * FROM leaved WHERE leaf IN (SELECT leaf FROM live)),
kinds AS (SELECT leaf, h, any_value(masked) AS masked, any_value(n) AS n, count(DISTINCT doc) AS c FROM places GROUP BY leaf, h),
models AS (SELECT leaf, h AS model, masked AS model_text FROM kinds QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY c DESC, h DESC) = 1),
rare AS (
  SELECT k.h, k.n, k.masked, m.model,
    10 * len(list_filter(range(1, k.n + 1), lambda i: string_split(k.masked, ' ')[i] = string_split(m.model_text, ' ')[i])) >= 7 * k.n AS fits
  FROM kinds k JOIN models m USING (leaf) WHERE k.c < 5),
places_left AS (SELECT h, string_split(masked, ' ') AS tokens, unnest(range(4, n + 1)) AS place FROM rare WHERE NOT fits AND 10 * (n - 1) >= 7 * n),
groups AS (
  SELECT h, model AS template FROM rare WHERE fits
  UNION SELECT model, model FROM rare WHERE fits
  UNION SELECT h, array_to_string(list_concat(tokens[:place - 1], [chr(9) || place], tokens[place + 1:]), ' ') FROM places_left),
often AS (SELECT template FROM places JOIN groups USING (h) GROUP BY template HAVING count(DISTINCT doc) >= 5),
bad_lines AS (SELECT h FROM kinds WHERE c >= 5 UNION SELECT h FROM groups WHERE template IN (SELECT template FROM often)),
bad AS (SELECT DISTINCT k, pos FROM places WHERE h IN (SELECT h FROM bad_lines)),
kept AS (
  SELECT l.k, count(*) AS n_lines, count(b.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.pos IS NULL) AS text
  FROM lines l LEFT JOIN bad b USING (k, pos) GROUP BY l.k)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE x.n_lines END::INTEGER AS n_lines, x.n_dropped::INTEGER AS n_dropped, coalesce(x.text, '') AS text
FROM docs d JOIN kept x USING (k)
"""
