"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from constellate.llm import bpe, leakage, lookalike, names, pairs, subjects, topn


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.shared_playlists(_table(spark, d, "harvested_playlists")).select("id_a", "id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_neighbours(_table(spark, d, "crossover_neighbors"), n=10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_artists(_table(spark, d, "harvested_playlists"), _table(spark, d, "atlas_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.odd_texts(_table(spark, d, "harvested_playlists"), _table(spark, d, "atlas_nodes"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "text", min_words=12)
    return found.select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents with leaked passages: their leaked words, and whether the whole document is dropped."""
    out = leakage.without_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "text", min_words=12, max_coverage=0.5)
    return out.where("leaked_words > 0").select("doc_id", "leaked_words", "dropped")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(
        _table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "subject_examples"), _table(spark, d, "subject_areas"), share=0.25)


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
}

_INC = "SELECT DISTINCT id, t.artist_id AS a FROM (SELECT id, unnest(tracks) AS t FROM harvested_playlists) WHERE t.artist_id IS NOT NULL AND t.artist_id <> '' AND id IS NOT NULL"

# Words of a text, as far as SQL can fold character forms: full-width signs, odd blanks, unseen characters.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u00a0\u2007\u2009\u202f\u3000"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " " * 5
_WORDS = (
    "regexp_extract_all(lower(translate(regexp_replace(text, '[\\x{200b}-\\x{200f}\\x{ad}\\x{2060}\\x{feff}\\x{fe00}-\\x{fe0f}]', '', 'g'), "
    f"'{_FULL}', '{_HALF.replace(chr(39), chr(39) * 2)}')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
)


def _runs(table: str, key: str, n: int = 12) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(ws[i:i + {n - 1}], ' ') AS run FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM (SELECT {key}, {_WORDS} AS ws FROM {table} WHERE text IS NOT NULL)))"


# Windows of twelve words that also occur in an item, by document and place; the words they cover are the leaked ones.
_COVERED = f"""(SELECT DISTINCT doc_id, n, unnest(range(i, i + 12)) AS at FROM (
    SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i:i + 11], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL)))
    WHERE run IN (SELECT run FROM {_runs('eval_items', 'item_id')}))"""

ORACLES = {
    "p7_clean": f"SELECT doc_id, CAST(count(*) AS INTEGER) AS leaked_words, count(*) > 0.5 * max(n) AS dropped FROM {_COVERED} GROUP BY doc_id",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id')} JOIN {_runs('eval_items', 'item_id')} USING (run)",
    "p2_found": f"""
        WITH inc AS ({_INC}), sup AS (SELECT a, count(*) AS n FROM inc GROUP BY a),
        pairs AS (SELECT x.a AS id_a, y.a AS id_b, count(*) AS n FROM inc x JOIN inc y ON x.id = y.id AND x.a < y.a GROUP BY 1, 2 HAVING count(*) >= 5)
        SELECT id_a, id_b FROM pairs p JOIN sup s ON s.a = p.id_a JOIN sup t ON t.a = p.id_b
        WHERE p.n * (SELECT count(DISTINCT id) FROM harvested_playlists) >= 5 * s.n * t.n""",
    "p5_found": """
        WITH latest AS (
          SELECT id, "neighborId", "overlapPercent", "sharedPlaylists",
            row_number() OVER (PARTITION BY id, "neighborId" ORDER BY exported_at DESC NULLS LAST, "overlapPercent" DESC NULLS LAST, "sharedPlaylists" DESC NULLS LAST) AS k
          FROM crossover_neighbors WHERE "neighborId" IS NOT NULL AND id IS NOT NULL),
        ranked AS (
          SELECT id, "neighborId", row_number() OVER (PARTITION BY id ORDER BY "overlapPercent" DESC, "sharedPlaylists" DESC NULLS LAST, "neighborId" ASC) AS r
          FROM latest WHERE k = 1 AND "overlapPercent" IS NOT NULL)
        SELECT id, "neighborId" FROM ranked WHERE r <= 10""",
}
