"""Schemas of the data model and the rank domain."""

from __future__ import annotations

from pyspark.sql import types as T

#: The ranks in order; their place is the rank's number, 0 is unranked.
RANKS = (
    "no rank",
    "superkingdom",
    "kingdom",
    "subkingdom",
    "superphylum",
    "phylum",
    "subphylum",
    "superclass",
    "class",
    "subclass",
    "infraclass",
    "cohort",
    "subcohort",
    "superorder",
    "order",
    "suborder",
    "infraorder",
    "parvorder",
    "superfamily",
    "family",
    "subfamily",
    "tribe",
    "subtribe",
    "genus",
    "subgenus",
    "section",
    "subsection",
    "series",
    "species group",
    "species subgroup",
    "species",
    "subspecies",
    "varietas",
    "forma",
    "forma specialis",
    "strain",
    "isolate",
)
#: Other names of ranks.
RANK_ALIASES = {"domain": "superkingdom", "realm": "superkingdom"}
#: Names that a taxonomy dump uses for ranks of the domain.
RANK_SYNONYMS = {
    "morph": "subspecies",
    "subvariety": "subspecies",
    "pathogroup": "subspecies",
    "serogroup": "subspecies",
    "biotype": "varietas",
    "genotype": "varietas",
    "serotype": "varietas",
    "domain": "superkingdom",
    "realm": "superkingdom",
    "clade": "no rank",
}
RANK_INDEX = {name: i for i, name in enumerate(RANKS)} | {a: RANKS.index(b) for a, b in RANK_ALIASES.items()}


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
CUBE = _table(("samplename", _S), ("otuname", _S), ("nreads", _L))
CALIBRATED_CUBE = _table(("samplename", _S), ("otuname", _S), ("ncopies", _D))
MEMBERSHIP = _table(("otuname", _S), ("readname", _S))
SEQUENCE = _table(("name", _S), ("seq", _S))
READ = _table(("rec_no", _L), ("name", _S), ("seq", _S), ("qual", _S))
NODES = _table(("taxid", _L), ("parent", _L), ("rank", _S))
NAMES = _table(("taxid", _L), ("name", _S), ("nameclass", _S))
ACC_TAXID = _table(("acc", _S), ("taxid", _L))
ASSIGNMENT = _table(("query", _S), ("rank_idx", _I), ("taxon", _S))
NEIGHBOURS = _table(("query", _S), ("acc", _S))
HITS = _table(("query", _S), ("acc", _S), ("score", _L), ("length", _I), ("qcov", _D))
CLUSTER_HITS = _table(("type", _S), ("length", _I), ("pident", _D), ("cigar", _S), ("query", _S), ("target", _S))
REPLICATES = _table(("child", _S), ("parent", _S))
SPIKE_INS = _table(("samplename", _S), ("stdname", _S), ("conc", _D))
VOLUMES = _table(("samplename", _S), ("volume", _D))
