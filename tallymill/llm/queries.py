"""Registered queries of this folder, each on its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import ann, codes, decontamination, html_text, jaccard, merkle, packing, pii, quality, secrets, sharding, simhash, warc
from tallymill.llm.common import shared_folder
from tallymill.llm.spans import count_of, written

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.OrdinalModel:
    ratings = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.train(docs, ratings)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document; see :mod:`tallymill.llm.quality`."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; see :mod:`tallymill.llm.pii`."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), "text", ("doc_id",))
    counts = [count_of(F.col("pii_base"), at).alias(f"n_{kind}") for at, kind in enumerate(pii.BASE_KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("pii_base"), pii.KINDS), 256).alias("base_sha256"),
        written(F.col("pii_spans"), pii.KINDS).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; see :mod:`tallymill.llm.secrets`."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    counts = [count_of(F.col("secret_base"), at).alias(f"n_{kind}") for at, kind in enumerate(secrets.BASE_KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("secret_base"), secrets.KINDS), 256).alias("base_sha256"),
        written(F.col("secret_spans"), secrets.KINDS).alias("spans"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page written to archives and read back; see :mod:`tallymill.llm.warc`."""
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(pages, "archives")
    warc.write_archives(pages, folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth; see :mod:`tallymill.llm.ann`."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences; see :mod:`tallymill.llm.packing`."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see :mod:`tallymill.llm.html_text`."""
    return html_text.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes; see :mod:`tallymill.llm.sharding`."""
    placed = sharding.shard_records(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("record_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, as pairs; see :mod:`tallymill.llm.decontamination`."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets; see :mod:`tallymill.llm.jaccard`."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector by four codebooks; see :mod:`tallymill.llm.codes`."""
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.drop("label").withColumn("codebooks_sha256", F.lit(codes.digest_of(books)))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with close fingerprints; see :mod:`tallymill.llm.simhash`."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; see :mod:`tallymill.llm.merkle`."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_warc": op4_warc,
    "op5_ann": op5_ann,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard": op10_jaccard,
    "op11_codes": op11_codes,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
}


def _measured(*values: str) -> str:
    """The text that a leaf is the hash of."""
    texts = [f"CAST({v} AS VARCHAR)" for v in values]
    return " || ".join(f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts)


def _levels(name: str, leaves: str) -> str:
    """A recursive table of all nodes (tree, level, place, n, digest) above the ``leaves``."""
    return f"""
        {name}(tree, level, place, n, digest) AS (
            SELECT tree, 0, place, n, digest FROM {leaves}
            UNION ALL
            SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
            FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2, n
        )"""


def _walks(name: str, nodes: str, start: str) -> str:
    """A recursive table of the ways up from ``start`` (id, tree, place, n, digest, proof) beside the siblings in ``nodes``."""
    return f"""
        {name}(id, tree, level, place, n, digest, proof) AS (
            SELECT id, tree, 0, place, n, digest, proof FROM {start}
            UNION ALL
            SELECT id, w.tree, w.level + 1, w.place // 2, (w.n + 1) // 2,
                sha256(CASE WHEN w.place % 2 = 1 THEN s.digest || w.digest ELSE w.digest || coalesce(s.digest, '') END),
                w.proof || coalesce(s.digest, '')
            FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1)
            WHERE w.n > 1
        )"""


_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, code: list_reduce(
        list_prepend(xor(crc, code), [CAST(0 AS BIGINT) FOR i IN range(8)]),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_MERKLE_SQL = f"""
    WITH RECURSIVE hashed AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree,
            sha256({_measured("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
            sha256({_measured("doc_id", "source", "lang", "CAST(n_chars AS HUGEINT) + 1", "text")}) AS altered,
            {_CRC32} % 7 = 0 AS tampered
        FROM documents
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
            count(*) OVER (PARTITION BY tree) AS n, leaf AS digest
        FROM hashed
    ), {_levels("node", "placed")}, subroots AS (
        SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place,
            count(*) OVER () AS n, digest, '' AS tree FROM node WHERE n = 1
    ), {_levels("top", "subroots")}, starts AS (
        SELECT id, tree, place, n, CASE WHEN tampered THEN altered ELSE leaf END AS digest, '' AS proof FROM placed
    ), {_walks("walk", "node", "starts")}, halfway AS (
        SELECT w.id, s.tree, s.place, s.n, w.digest, w.proof FROM walk w JOIN subroots s ON s.name = w.tree WHERE w.n = 1
    ), {_walks("last", "top", "halfway")}
    SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root,
        w.digest = t.digest AS verified
    FROM placed p JOIN subroots s ON s.name = p.tree JOIN last w ON w.id = p.id AND w.n = 1 JOIN top t ON t.n = 1
"""



def _round_sql(k: int) -> str:
    """Nearest entries of book ``k`` and the book that follows it."""
    return f"""
    code{k} AS MATERIALIZED (
        SELECT row, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m
        FROM part JOIN book{k} USING (p) GROUP BY row, p
    ), mean{k} AS (
        SELECT p, e, list(floor(s / n) ORDER BY i) AS c
        FROM (
            SELECT p, m % 256 AS e, i, sum(x[i]) AS s, count(*) AS n
            FROM part JOIN code{k} USING (row, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY 1, 2, 3
        ) GROUP BY p, e
    ), book{k + 1} AS MATERIALIZED (
        SELECT p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
    ),"""


_CODES_SQL = f"""
    WITH whole AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, label,
            list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), part AS MATERIALIZED (
        SELECT row, p, v[len(v) * p // 4 + 1 : len(v) * (p + 1) // 4] AS x FROM whole, range(4) AS t(p)
    ), first AS (
        SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM whole
    ), book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN first USING (row) WHERE e < 256),
    {"".join(map(_round_sql, range(4)))}
    last AS MATERIALIZED (
        SELECT row, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m
        FROM part JOIN book4 USING (p) GROUP BY row, p
    ), coded AS (
        SELECT row, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM last GROUP BY row
    ), books AS (
        SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
        FROM book4, unnest(range(1, len(c) + 1)) AS t(i)
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM whole JOIN coded USING (row), books
"""

ORACLE_SQL: dict[str, str] = {
    "op11_codes": _CODES_SQL,
    "op13_merkle": _MERKLE_SQL,
    "op4_warc": """
        WITH page AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), first AS (
            SELECT payload_digest, min(page_id) AS first_id FROM page WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
        )
        SELECT page_id, payload_bytes, page.payload_digest,
            CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM page LEFT JOIN first ON page.payload_digest = first.payload_digest
    """,
}
