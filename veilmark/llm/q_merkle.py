"""Query op12: a Merkle manifest of all documents, and which leaves still prove the root after some texts changed."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import table
from veilmark.llm.merkle import folded_root, leaf_of, merkle_manifest, proof


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    shown = F.when(tampered, leaf_of(*others, F.translate("text", ascii_uppercase, ascii_lowercase)))
    leaves = docs.select(F.col("source").alias("tree"), leaf_of(*others, F.col("text")).alias("node"), "doc_id", shown.alias("shown"))
    rows = merkle_manifest(leaves, [F.col("doc_id").asc_nulls_first()])
    return rows.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(proof(), 256).alias("proof_sha256"), folded_root("coalesce(shown, node)").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

_LEVELS = 8


def _levels(name: str, tree: str) -> str:
    """Level after level of the trees `name`0 (tree, pos, node, n): {name}1, ... and their runs {name}r0, ...; `tree` is the group column."""
    out = []
    for k in range(_LEVELS):
        out.append(f"{name}r{k} AS (SELECT {tree}, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS nodes, max(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(
            f"{name}{k + 1} AS (SELECT {tree}, pos, node, n FROM {name}{k} WHERE n = 1 "
            f"UNION ALL SELECT {tree}, run AS pos, sha256(nodes) AS node, (n + 15) // 16 AS n FROM {name}r{k} WHERE n > 1)"
        )
    return ",\n".join(out)


def _climb(name: str, tree: str, start: str, keep: str) -> str:
    """{name}p{k}: rows of `start` (tree, pos, proof, folded, columns `keep`) after k levels."""
    out = [f"{name}p0 AS ({start})"]
    for k in range(_LEVELS):
        place = f"(p.pos // {16**k}) % 16"
        left, right = f"left(r.nodes, 64 * ({place}))", f"substr(r.nodes, 64 * ({place}) + 65)"
        out.append(
            f"{name}p{k + 1} AS (SELECT p.{tree}, p.pos, {keep}, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
            f"CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded "
            f"FROM {name}p{k} p JOIN {name}r{k} r ON p.{tree} IS NOT DISTINCT FROM r.{tree} AND r.run = CASE WHEN r.n > 1 THEN p.pos // {16 ** (k + 1)} ELSE 0 END)"
        )
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


#: CRC-32 bit by bit: DuckDB has none of its own.
CRC32_TABLE = "crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i))"


def crc32_sql(text: str, steps: str = "(SELECT steps FROM crc_table)") -> str:
    """DuckDB SQL: the unsigned CRC-32 of a string's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    byte_list = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    folded = f"list_reduce(list_concat([4294967295], {byte_list}), lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1]))"
    return f"xor({folded}, 4294967295)"


_HEAD = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
_LEAF = f"sha256({' || '.join([*_HEAD, _field('text')])})"
_LOWERED = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
_TAMPERED = f"sha256({' || '.join([*_HEAD, _field(_LOWERED)])})"

ORACLE_SQL = {
    "op12_merkle_manifest": f"""
        WITH {CRC32_TABLE},
        leaves AS (
            SELECT source, doc_id, {_LEAF} AS leaf,
                   CASE WHEN {crc32_sql("doc_id::VARCHAR", "steps")} % 5 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS shown
            FROM documents, crc_table
        ),
        t_all AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        t0 AS (SELECT source, pos, leaf AS node, n FROM t_all),
        {_levels("t", "source")},
        s_all AS (SELECT 0 AS top, source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t{_LEVELS}),
        s0 AS (SELECT top, pos, node, n FROM s_all),
        {_levels("s", "top")},
        {_climb("t", "source", "SELECT source, pos, doc_id, leaf, '' AS proof, shown AS folded FROM t_all", "doc_id, leaf")},
        {_climb("s", "top", f"SELECT top, s_all.pos, doc_id, leaf, s_all.node AS subroot, proof, folded FROM tp{_LEVELS} q JOIN s_all ON q.source IS NOT DISTINCT FROM s_all.source", "doc_id, leaf, subroot")}
        SELECT doc_id, leaf, subroot, s{_LEVELS}.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s{_LEVELS}.node AS verified
        FROM sp{_LEVELS} JOIN s{_LEVELS} ON s{_LEVELS}.top = sp{_LEVELS}.top
    """,
}
