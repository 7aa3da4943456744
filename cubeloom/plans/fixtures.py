"""The engine's tables derived from the benchmark tables, in Spark and as SQL.

``SQL`` holds the same definitions as common table expressions, by name, for
queries that are written in SQL on both sides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators import cube
from cubeloom.session import written

SQL = {
    "cube_l": """cube_l AS (SELECT concat('run1__s', CAST(l_suppkey AS VARCHAR), '__', l_returnflag) AS samplename,
        concat('otu_', CAST(l_partkey AS VARCHAR)) AS otuname, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nreads
        FROM lineitem GROUP BY 1, 2)""",
    "cube_e": """cube_e AS (SELECT concat('run1__u', CAST(user_id AS VARCHAR), '__ev') AS samplename, event_type AS otuname,
        count(*) AS nreads FROM events GROUP BY 1, 2)""",
    "reads_e": """reads_e AS (SELECT event_type AS otuname, concat('r', CAST(event_id AS VARCHAR), ' SN:run1__u', CAST(user_id AS VARCHAR), '__ev') AS readname FROM events)""",
    "repl": """repl AS (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS child, concat('u', CAST(user_id - user_id % 3 AS VARCHAR)) AS parent FROM events)""",
    "assign_p": """assign_p AS (SELECT concat('otu_', CAST(p_partkey AS VARCHAR)) AS query, p_type AS class,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS genus, p_name AS species FROM part)""",
    "nodes": """nodes AS (SELECT CAST(100 + r_regionkey AS BIGINT) AS taxid, CAST(1 AS BIGINT) AS parent, 'phylum' AS rank, r_name AS name FROM region
        UNION ALL SELECT 1000 + n_nationkey, 100 + n_regionkey, 'class', n_name FROM nation
        UNION ALL SELECT 10000 + s_suppkey, 1000 + s_nationkey, 'species', concat('S', CAST(s_suppkey AS VARCHAR)) FROM supplier
        UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, 'species', concat('C', CAST(c_custkey AS VARCHAR)) FROM customer)""",
    "acc_taxid": """acc_taxid AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS acc, CAST(10000 + s_suppkey AS BIGINT) AS taxid FROM supplier
        UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), 1000000 + c_custkey FROM customer)""",
    "seq_d": """seq_d AS (SELECT doc_id, concat('d', CAST(doc_id AS VARCHAR)) AS name, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
        translate(md5(concat(text, 'q')), '0123456789abcdef', '!#%()+-/13579;=?') AS qual FROM documents)""",
}


SQL["seq_l"] = """seq_l AS (SELECT doc_id, concat('d', CAST(doc_id AS VARCHAR)) AS name, translate(concat(md5(text), md5(concat(text, '1')), md5(concat(text, '2')), md5(concat(text, '3'))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents WHERE text IS NOT NULL)"""
#: The true sequences of ``reads_l``: every second one differs from the one before in its tenth letter.
SQL["true_l"] = """true_l AS (SELECT k, CASE WHEN k % 2 = 0 THEN t ELSE concat(substr(t, 1, 9), translate(substr(t, 10, 1), 'ACGT', 'CGTA'), substr(t, 11)) END AS seq
        FROM (SELECT k, translate(concat(md5(concat('t', CAST(k // 2 AS VARCHAR))), md5(concat('u', CAST(k // 2 AS VARCHAR)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS t FROM (SELECT DISTINCT l_suppkey % 40 AS k FROM lineitem)))"""


def cte(*names: str) -> str:
    """A ``WITH`` clause of the named tables."""
    return "WITH " + ", ".join(SQL[n] for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items in a share.
_SHARE = 200_000


def shares(spark: SparkSession, d: str) -> int:
    """Partitions for the cells of ``cube_l``; their number grows with the line items, a task's memory doesn't."""
    return max(1, -(-table(spark, d, "lineitem").count() // _SHARE))


def cube_l(spark: SparkSession, d: str) -> DataFrame:
    sample = F.concat(F.lit("run1__s"), F.col("l_suppkey").cast("string"), F.lit("__"), F.col("l_returnflag"))
    item = F.concat(F.lit("otu_"), F.col("l_partkey").cast("string"))
    cells = table(spark, d, "lineitem").select(sample.alias("samplename"), item.alias("otuname"), F.col("l_quantity").cast("long").alias("nreads"))
    return cube.summed(cells, shares(spark, d))


def cube_e(spark: SparkSession, d: str) -> DataFrame:
    sample = F.concat(F.lit("run1__u"), F.col("user_id").cast("string"), F.lit("__ev"))
    return table(spark, d, "events").groupBy(sample.alias("samplename"), F.col("event_type").alias("otuname")).agg(F.count("*").alias("nreads"))


def reads_e(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("r"), F.col("event_id").cast("string"), F.lit(" SN:run1__u"), F.col("user_id").cast("string"), F.lit("__ev"))
    return table(spark, d, "events").select(F.col("event_type").alias("otuname"), name.alias("readname"))


def replicates(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, d, "events").select(F.concat(F.lit("u"), user.cast("string")).alias("child"), F.concat(F.lit("u"), (user - user % 3).cast("string")).alias("parent")).distinct()


def assign_p(spark: SparkSession, d: str) -> DataFrame:
    genus = F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    return table(spark, d, "part").select(F.concat(F.lit("otu_"), F.col("p_partkey").cast("string")).alias("query"), F.col("p_type").alias("class"), genus.alias("genus"), F.col("p_name").alias("species"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, base: int, key: str, parent, rank: str, label) -> DataFrame:
        return table(spark, d, name).select((F.col(key).cast("long") + base).alias("taxid"), parent.cast("long").alias("parent"), F.lit(rank).alias("rank"), label.alias("name"))

    region = part("region", 100, "r_regionkey", F.lit(1), "phylum", F.col("r_name"))
    nation = part("nation", 1000, "n_nationkey", F.col("n_regionkey") + 100, "class", F.col("n_name"))
    supplier = part("supplier", 10000, "s_suppkey", F.col("s_nationkey") + 1000, "species", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    customer = part("customer", 1000000, "c_custkey", F.col("c_nationkey") + 1000, "species", F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    return region.unionByName(nation).unionByName(supplier).unionByName(customer)


def acc_taxid(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).filter("rank = 'species'").select(F.col("name").alias("acc"), "taxid")


def seq_d(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.translate(F.md5(text.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"),
        F.translate(F.md5(F.concat(text, F.lit("q")).cast("binary")), "0123456789abcdef", "!#%()+-/13579;=?").alias("qual"),
    )


def seq_l(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of 128 letters, one for each text."""
    text = F.col("text")
    digests = F.concat(*[F.md5(F.concat(text, F.lit(x)).cast("binary")) for x in ("", "1", "2", "3")])
    return table(spark, d, "documents").filter(text.isNotNull()).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.translate(digests, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


def reads_l(spark: SparkSession, d: str) -> DataFrame:
    """``readname, seq, qual``: a read of 64 letters for each line item, copied from a true sequence with errors at the rates of their qualities.

    Qualities are 40, 30, 20 and 12, and an error is the next letter but one or two.
    """
    k = F.col("l_suppkey") % 40
    half = F.floor(k / 2).cast("long").cast("string")
    digits = F.concat(F.md5(F.concat(F.lit("t"), half).cast("binary")), F.md5(F.concat(F.lit("u"), half).cast("binary")))
    base = F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT")
    other = F.concat(F.substring(base, 1, 9), F.translate(F.substring(base, 10, 1), "ACGT", "CGTA"), F.substring(base, 11, 64))
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    noise = F.translate(F.concat(F.md5(key.cast("binary")), F.md5(F.concat(key, F.lit("q")).cast("binary"))), "0123456789abcdef", "IIIIIIIIII???55-")
    items = table(spark, d, "lineitem").select(key.alias("readname"), F.when(k % 2 == 0, base).otherwise(other).alias("seq"), noise.alias("qual"))
    return written(items.mapInPandas(_misread, "readname string, seq string, qual string"), "reads")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: The chance of an error in 100,000 for each letter of a quality.
_RATES = np.full(256, 6310)
_RATES[[ord(c) for c in "I?5"]] = 10, 100, 1000
#: Errors by ``[dice % 3, letter]``: the next letter, the next but one, the one before.
_WRONG = np.zeros((3, 256), np.uint8)
for _to, _row in zip(("CGTA", "GTAC", "TACG"), _WRONG):
    _row[[ord(c) for c in "ACGT"]] = [ord(c) for c in _to]


def crcs(names: Iterable[str], n: int) -> np.ndarray:
    """crc32 of ``name#i``, a row for each name and a column for each *i* from 1 to *n* (99 at most)."""
    began = np.array([zlib.crc32(f"{x}#".encode()) for x in names], dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)

    def with_digit(state: np.ndarray, digit: int) -> np.ndarray:
        return _CRC[(state ^ np.uint32(48 + digit)) & np.uint32(255)] ^ (state >> np.uint32(8))

    tens = [began, *(with_digit(began, t) for t in range(1, n // 10 + 1))]
    return np.stack([with_digit(tens[i // 10], i % 10) for i in range(1, n + 1)], axis=1) ^ np.uint32(0xFFFFFFFF)


def _misread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads of 64 letters with errors at the rates of their qualities."""
    for frame in frames:
        known = frame[frame["seq"].notna()]  # null suppliers have no true sequence
        out = frame.assign(seq="")
        if len(known):
            true, qual = (np.frombuffer("".join(known[c]).encode("ascii"), np.uint8).reshape(-1, 64) for c in ("seq", "qual"))
            dice = crcs(known["readname"], 64) % np.uint32(100_000)
            read = np.where(dice < _RATES[qual], _WRONG[dice % 3, true], true)
            out.loc[known.index, "seq"] = [x.decode() for x in read.view("S64").ravel().tolist()]
        yield out


def keys(spark: SparkSession, d: str, status: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").cast("string").alias("acc"))


def long_assignment(wide: DataFrame, ranks: list[str]) -> DataFrame:
    """``query, rank_idx, taxon`` of a wide assignment table; blanks are left out."""
    from cubeloom.schemas import RANK_INDEX

    index = F.create_map(*[x for r in ranks for x in (F.lit(r), F.lit(RANK_INDEX[r]))])
    long = wide.unpivot("query", ranks, "rank", "taxon").filter("taxon is not null and taxon != ''")
    return long.select("query", index[F.col("rank")].alias("rank_idx"), "taxon")
