"""Source divergence audit: how far the word use of each source of a language lies from the others'.

DuckDB counts inside the tasks, Spark deals the shards and merges. Each block of documents becomes counts of
(lang, source, term) by vectorised SQL; partial counts are dealt into shards by a hash of lang and term, so that all
sources of a term meet in one shard; SQL there adds them up and keeps the terms of enough documents. Once Spark has
the totals of each group, a second SQL over each shard gives partial sums of all pairs of sources and the shard's
best terms of each source; Spark adds the pair sums, merges the best terms and ranks both.

Rows: null text, lang and source count as ''. Terms are runs of letters A-Z and of characters beyond ASCII, only A-Z
lower-cased. A group without terms takes part with counts of 0; a language without kept terms gives pairs of value 0
and no terms. Empty texts add a group only, texts of any length are read whole, repeated rows count as often as they
occur, an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import discard, materialize, runs
from netloom.llm.library_tokens import blocks

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Rows of a shard on average, rows a task holds before it gives its partial counts away, and DuckDB's memory in a task.
SHARD_ROWS, HELD_ROWS, MEMORY = 200_000, 600_000, "500MB"

#: Counts of one block; the term '' stands for the group itself.
BLOCK_SQL = f"""
WITH docs AS (SELECT place, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM rows),
     own AS (SELECT place, lang, source, term, count(*) AS n FROM docs GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM own GROUP BY ALL
UNION ALL SELECT lang, source, '', 0, count(*) FROM rows GROUP BY ALL
"""
ADDED_SQL = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
#: Counts of the kept terms of one shard.
KEPT_SQL = """
WITH added AS (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM cell GROUP BY ALL)
SELECT lang, term, source, n::BIGINT AS n FROM added QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}
"""
_P = f"(1 + ({UNIT}::HUGEINT * ({{n}} + 2)) // ({{total}}::HUGEINT + 2 * {{v}}::HUGEINT))::BIGINT"
_F = "((({a}) - ({b})) * (({a}) - ({b}))) // (({a}) + ({b}))"
#: p of every group of a lang for a term that it does not have.
_ABSENT = f"absent AS (SELECT source, total, v, CASE WHEN v > 0 THEN {_P.format(n=0, total='total', v='v')} END AS p FROM groups)"
#: Partial sums over the terms of one shard: as if no source had a term, and what the terms that occur change.
PAIR_SQL = f"""
WITH {_ABSENT},
     held AS (SELECT term, source, {_P.format(n='n', total='total', v='v')} AS p, absent.p AS p0 FROM cell JOIN absent USING (source)),
     base AS (SELECT a.source AS source, b.source AS item, coalesce((SELECT count(DISTINCT term) FROM cell) * ({_F.format(a='a.p', b='b.p')}), 0) AS value
              FROM absent a JOIN absent b ON a.source < b.source),
     alike AS (SELECT source, p, p0, count(*) AS terms FROM held GROUP BY ALL),
     one AS (SELECT least(h.source, b.source) AS source, greatest(h.source, b.source) AS item, sum(h.terms * ({_F.format(a='h.p', b='b.p')} - {_F.format(a='h.p0', b='b.p')}))::BIGINT AS value
             FROM alike h JOIN absent b ON h.source <> b.source GROUP BY ALL),
     two AS (SELECT a.source AS source, b.source AS item, sum({_F.format(a='a.p', b='b.p')} - {_F.format(a='a.p', b='b.p0')} - {_F.format(a='a.p0', b='b.p')} + {_F.format(a='a.p0', b='b.p0')})::BIGINT AS value
             FROM held a JOIN held b ON a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT source, item, sum(value)::BIGINT AS value FROM (FROM base UNION ALL FROM one UNION ALL FROM two) GROUP BY ALL
"""
#: The terms of one shard that each source uses most above its lang.
TERM_SQL = f"""
WITH whole AS (SELECT term, sum(n) AS n FROM cell GROUP BY term),
     used AS (SELECT source, term, {_P.format(n='cell.n', total='groups.total', v='groups.v')} AS p, {_P.format(n='whole.n', total='groups.of_lang', v='groups.v')} AS q
              FROM cell JOIN groups USING (source) JOIN whole USING (term))
SELECT source, term AS item, {_F.format(a='p', b='q')} AS value FROM used WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, term) <= {{top}}
"""


def _database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task's documents; term '' with the documents of a group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            parts, held = [], 0
            for batch in blocks(batches, 2):
                text = pc.ascii_lower(batch.column(2))
                rows = pa.table({"place": pa.array(range(batch.num_rows)), "lang": batch.column(0), "source": batch.column(1), "text": text})  # noqa: F841
                db.register("rows", rows)
                parts.append(db.execute(BLOCK_SQL).to_arrow_table())
                db.unregister("rows")
                held += parts[-1].num_rows
                if held > HELD_ROWS:
                    parts = [_added(db, parts)]
                    held = parts[0].num_rows
                    if held > HELD_ROWS // 2:
                        yield from parts[0].cast(schema).to_batches()
                        parts, held = [], 0
            if parts:
                yield from _added(db, parts).cast(schema).to_batches()

    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _added(db, parts: list[pa.Table]) -> pa.Table:
    db.register("held", pa.concat_tables(parts))
    out = db.execute(ADDED_SQL).to_arrow_table()
    db.unregister("held")
    return out


def kept_counts(partial: DataFrame, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """shard, lang, term, source, n of the terms in at least `least` documents of their lang, from materialized partial counts."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            for (shard,), cell in runs(batches, 1):
                db.register("cell", cell)
                out = db.execute(KEPT_SQL.format(least=least)).to_arrow_table()
                db.unregister("cell")
                out = out.add_column(0, "shard", pa.array([shard] * out.num_rows, pa.int32()))
                yield from out.cast(schema).to_batches()

    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    rows = partial.where("term <> ''").select(shard, "lang", "term", "source", "n", "docs")
    dealt = rows.repartition(_parts(partial), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, lang string, term string, source string, n long")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    partial = materialize(counts(docs))
    shards = max(1, -(-partial.count() // SHARD_ROWS))
    kept = materialize(kept_counts(partial, shards, least))
    groups = partial.where("term = ''").select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a shard has all sources of a term: a lang's terms are the sum of its shards' terms
    vocabulary = kept.groupBy("lang", "shard", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("of_lang"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "v", "of_lang")]
    groups = materialize(groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", *zero))
    cells = kept.select("lang", "shard").distinct().union(groups.where("v = 0").select("lang", F.lit(0).alias("shard")).distinct())
    none = [F.lit(0).cast("long").alias(c) for c in ("total", "v", "of_lang")]
    head = groups.join(cells, "lang").select("lang", "shard", F.lit(0).alias("kind"), F.lit("").alias("term"), "source", F.lit(0).cast("long").alias("n"), "total", "v", "of_lang")
    rows = head.unionByName(kept.select("lang", "shard", F.lit(1).alias("kind"), "term", "source", "n", *none))
    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            for (lang, _), cell in runs(batches, 2):
                db.register("rows", cell)
                db.execute("CREATE OR REPLACE TABLE groups AS SELECT source, total, v, of_lang FROM rows WHERE kind = 0")
                db.execute("CREATE OR REPLACE TABLE cell AS SELECT term, source, n FROM rows WHERE kind = 1")
                db.unregister("rows")
                for part, sql in (("pair", PAIR_SQL), ("term", TERM_SQL.format(top=top))):
                    out = db.execute(sql).to_arrow_table()
                    own = [pa.array([name] * out.num_rows, pa.string()) for name in (lang, part)]
                    yield from pa.table([*own, *out.columns], schema.names).cast(schema).to_batches()

    at = ["lang", "shard"]
    # the tables of a cell are made again for each cell: sorted rows bring the groups of a cell before its terms
    dealt = rows.repartition(_parts(docs), *at).sortWithinPartitions(*at, "kind")
    found = dealt.select(*at, "kind", "term", "source", "n", "total", "v", "of_lang").mapInArrow(run, "lang string, part string, source string, item string, value long")
    found = materialize(found)
    for used in (partial, kept, groups):
        discard(used)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p")
    pairs = pairs.select("lang", both, "value").select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")
    every = pairs.unionByName(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """The same result in one DuckDB statement over documents, every term against every pair of sources."""
    p, letters = _P, "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {letters}, lower({letters})) AS text FROM documents),
     words AS (SELECT place, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM docs),
     kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT place) >= {least}),
     groups AS (SELECT DISTINCT lang, source FROM docs),
     n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
     p AS (SELECT lang, source, term, n, {p.format(n='n', total='sum(n) OVER (PARTITION BY lang, source)', v='count(*) OVER (PARTITION BY lang, source)')} AS p FROM every),
     whole AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
     q AS (SELECT lang, term, {p.format(n='n', total='sum(n) OVER (PARTITION BY lang)', v='count(*) OVER (PARTITION BY lang)')} AS q FROM whole),
     sums AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum({_F.format(a='a.p', b='b.p')}) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     parts AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
               FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
               UNION ALL SELECT lang, source, 'term', term, ({_F.format(a='p', b='q')})::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


SQL = oracle()
