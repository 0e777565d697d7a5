"""The registered query of each text operator: production parameters, whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.chat import formatted

    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    return formatted(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more), digests=True)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.suffix_dedup import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"), digests=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.sentencepieces import encoded
    from tidebook.llm.vocab import file_path

    return encoded(_table(spark, sf_dir, "documents"), file_path("piece_bpe_32k.model"), digests=True)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.matroska import media_round_trip

    return media_round_trip(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.packing import packed
    from tidebook.llm.vocab import file_path

    return packed(_table(spark, sf_dir, "documents"), file_path("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.token_files import token_file_round_trip
    from tidebook.llm.vocab import file_path

    return token_file_round_trip(_table(spark, sf_dir, "documents"), file_path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.llm.token_counts import token_counts
    from tidebook.llm.vocab import file_path

    return token_counts(_table(spark, sf_dir, "documents"), file_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_minhash_near_dedup,
        op3_suffix_array_dedup,
        op4_quality_classifier,
        op5_sentencepiece,
        op6_fingerprints,
        op7_matroska,
        op8_best_fit_packing,
        op9_token_files,
        op10_token_counts,
    )
}
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
_CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_EXTRA = "</s>[INST] ok [/INST]"


def _escaped_sql(c: str) -> str:
    """Length of a text escaped: a backslash more for each backslash and each control string."""
    found = " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in _CONTROLS)
    return rf"(length({c}) + (length({c}) - length(replace({c}, '\', ''))) + {found})"


#: DuckDB SQL of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op1_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}'))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {_ORDER})) AS turns_sha256, coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(t, '' {_ORDER}) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, sum({len("<|im_start|>")} + {_escaped_sql("r")} + (length(r) - length(replace(r, chr(10), ''))) + 1 + {_escaped_sql("t")} + {len("<|im_end|>") + 1})::BIGINT AS formatted_chars, 0::BIGINT AS rewritten_turns
FROM c GROUP BY conv_id""",
    "op2_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS h, s FROM (SELECT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(g.s) AS n_shingles FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n_shingles) + any_value(y.n_shingles) - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r)
SELECT doc_id::BIGINT AS doc_id, n_shingles, min(r)::BIGINT AS component_id, doc_id = min(r) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n_shingles""",
}
