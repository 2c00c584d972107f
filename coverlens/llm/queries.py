"""The operators as queries over the test tables, and SQL for those that SQL can express."""
from coverlens.llm import (cap_filters, chat_grammar, language_fusion, link_filter, lp_packing, shared_lists, simhash_anchors,
                           suffix_repeats, surrogates, template_decontam, token_records, toxicity_fm, turn_repair)

#: A conversation that is formatted with the others: texts that hold marks of the template.
CONFLICT = "</s>[INST] ok [/INST]"


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_records(spark, sf):
    return token_records.token_records(_table(spark, sf, "documents"))


def op2_cap_filters(spark, sf):
    return cap_filters.near_copies(_table(spark, sf, "embeddings"))


def op3_toxicity_fm(spark, sf):
    return toxicity_fm.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_surrogates(spark, sf):
    return surrogates.report(_table(spark, sf, "documents"))


def op5_simhash_anchors(spark, sf):
    return simhash_anchors.groups(_table(spark, sf, "documents"))


def op6_language_fusion(spark, sf):
    return language_fusion.detect(_table(spark, sf, "pages"), _table(spark, sf, "documents"))


def op7_lp_packing(spark, sf):
    return lp_packing.pack_documents(_table(spark, sf, "documents"))


def op8_chat_grammar(spark, sf):
    table = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat_grammar.read_back(chat_grammar.formatted(table.unionByName(more)))


def op9_link_filter(spark, sf):
    return link_filter.verdicts(_table(spark, sf, "pages"))


def op10_template_decontam(spark, sf):
    return template_decontam.matches(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op11_turn_repair(spark, sf):
    return turn_repair.repair_damaged(_table(spark, sf, "conversations"))


def op12_suffix_repeats(spark, sf):
    return suffix_repeats.remove_repeats(_table(spark, sf, "documents"))


def op13_shared_lists(spark, sf):
    return shared_lists.mine(_table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_cap_filters, op3_toxicity_fm, op4_surrogates, op5_simhash_anchors,
                                   op6_language_fusion, op7_lp_packing, op8_chat_grammar, op9_link_filter, op10_template_decontam,
                                   op11_turn_repair, op12_suffix_repeats, op13_shared_lists)}
ORACLE = {"op9_link_filter": link_filter.sql(), "op13_shared_lists": shared_lists.sql()}
