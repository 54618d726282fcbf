"""The registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themata.llm import line_spread
from themata.llm.common import table
from themata.llm.crf import identify
from themata.llm.dialogue_repair import damage, digests, repair
from themata.llm.dialogue_trie import prefix_trie
from themata.llm.hash_tree import shard_documents
from themata.llm.kneser_ney import ORDER, train_and_score
from themata.llm.merkle import edit_likeness
from themata.llm.packing import pack
from themata.llm.probminhash import near_duplicate_classes
from themata.llm.repair import read_documents, write_ids
from themata.llm.style_tree import extract
from themata.llm.viterbi import round_trips
from themata.llm.weak_rules import judge
from themata.storage import new_folder


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, vocabulary_path("byte_bpe_50k.json"))
    return read_documents(spark, folder)


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.remove_widespread(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_removed")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), ORDER)


def op8_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op10_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(*columns, "base_failed", "kept", "quality")


def op11_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(table(spark, sf_dir, "conversations"))))


def op12_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_ids": op1_repair_ids,
    "op2_style_tree": op2_style_tree,
    "op3_merkle_tree": op3_merkle_tree,
    "op4_probminhash": op4_probminhash,
    "op5_crf_language": op5_crf_language,
    "op6_line_spread": op6_line_spread,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_streaming_viterbi": op8_streaming_viterbi,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_weak_rules": op10_weak_rules,
    "op11_edit_lattice": op11_edit_lattice,
    "op12_double_array": op12_double_array,
    "op13_hash_tree": op13_hash_tree,
}

#: The other queries have no SQL form; tests hold them against plain versions.
ORACLE: dict[str, Callable[[], str]] = {"op6_line_spread": line_spread.oracle}
