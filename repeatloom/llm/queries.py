"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm.components import linked_groups
from repeatloom.llm.lines import KINDS, document_statistics, fit_lines, label_lines
from repeatloom.llm.mixing import Target, mix
from repeatloom.llm.packing import pack_documents
from repeatloom.llm.heavy import WHITE_SPACE, frequent_share, most_frequent, normalised
from repeatloom.llm.survivors import best_fields, best_record, family_number
from repeatloom.llm.tokens import count_tokens
from repeatloom.llm.topn import top_n_per_group
from repeatloom.session import table

PROBES_PER_FAMILY = 5
FREQUENT_SHARE = 0.002
MOST_FREQUENT = 100
CONTAINER_TOKENS = 2048


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    best = top_n_per_group(table(spark, sf, "probes"), "family_id", "probe_id", "probe_score", PROBES_PER_FAMILY)
    return best.select("family_id", "probe_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_share(table(spark, sf, "reads"), "sequence", FREQUENT_SHARE).select("sequence")


def p3_top_sequences(spark: SparkSession, sf: str) -> DataFrame:
    top = most_frequent(normalised(table(spark, sf, "reads"), "sequence"), MOST_FREQUENT)
    return top.select(F.col("value").alias("sequence"), F.col("n").alias("n_reads"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "family_similarity").where("redundant_candidate")
    return linked_groups(pairs, "family_a", "family_b").where("group_id < member").select("group_id", F.col("member").alias("family_id"))


def _families(spark: SparkSession, sf: str) -> tuple:
    runs = table(spark, sf, "runs").select("run_id", "trust_rank")
    records = table(spark, sf, "families").join(runs, "run_id", "left")
    usable = {
        "support_read_count": F.col("support_read_count") >= 1,
        "support_span_bp": F.col("support_span_bp") >= 1,
        "mean_identity": F.col("mean_identity").between(0, 1),
        "confidence": F.col("confidence").isin("high", "medium", "low"),
    }
    return records, family_number("family_id"), F.col("record_id"), F.col("trust_rank"), F.col("loaded_at"), usable


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return best_fields(*_families(spark, sf)).select(F.col("group").alias("family_id"), "field_name", F.col("record").alias("record_id"))


def p5_best_record(spark: SparkSession, sf: str) -> DataFrame:
    best = best_record(*_families(spark, sf))
    return best.select(F.col("group").alias("family_id"), F.col("record").alias("record_id"), F.col("n_usable").cast("bigint").alias("n_usable"))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf, "documents", spread=True), ["doc_id"], "text")
    return pack_documents(sizes, "doc_id", CONTAINER_TOKENS)


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing: pages that came out, containers beyond capacity, pages split needlessly or in part."""
    packed = p7_pack(spark, sf)
    pages = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    pages = pages.agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= CONTAINER_TOKENS)).alias("split_needlessly"), F.count_if(F.col("n") != F.col("pieces")).alias("incomplete")
    )
    held = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > CONTAINER_TOKENS).alias("over_capacity"))
    return pages.join(held)  # a row each


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # mix_targets and common_words are fixed tables
    targets = {r["source"]: Target(r["target_share"], r["max_repeats"]) for r in table(spark, sf, "mix_targets").collect()}
    languages = sorted(r[0] for r in table(spark, sf, "common_words").select("lang").distinct().collect())
    band = F.when(F.col("page_no") == 1, "front").when(F.col("page_no") <= 4, "inner").when(F.col("page_no") > 4, "back")
    wanted = table(spark, sf, "documents", spread=True).where(F.col("source").isin(list(targets))).withColumn("topic", band)
    sizes = count_tokens(wanted, ["doc_id", "source", "lang", "topic"], "text")
    classes = {"lang": (F.col("lang"), languages), "topic": (F.col("topic"), ["front", "inner", "back"])}
    return mix(sizes, "doc_id", "source", classes, targets)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    chosen, shares = _mixed(spark, sf)
    reached = shares.select("source", "target_share", F.col("actual_share").alias("source_share"))
    return chosen.join(F.broadcast(reached), "source")  # a row per target


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any mix: by target, pages used too often or twice, and whether its share is that of its pages."""
    chosen, shares = _mixed(spark, sf)
    used = chosen.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    used = used.join(F.broadcast(shares.select("source", "max_repeats")), "source")  # a row per target
    used = used.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_repeats"), F.count_if(F.col("n") > 1).alias("twice"), F.sum("tokens").alias("tokens"))
    same = F.coalesce("tokens", F.lit(0)) == F.col("selected_tokens")
    return shares.join(used, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("over_repeats", "twice")], same.alias("share_holds"))


def _common_words(spark: SparkSession, sf: str) -> list[str]:
    return sorted({r[0] for r in table(spark, sf, "common_words").select("word").where("word is not null").collect()})  # a fixed table


def p9_labels(spark: SparkSession, sf: str) -> DataFrame:
    documents, words = table(spark, sf, "documents", spread=True), _common_words(spark, sf)
    return label_lines(documents, "doc_id", "text", fit_lines(documents, "text", words), words).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_labels(spark, sf).where("kind <> 'prose'").select("doc_id", "kind")


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any labels: a kind for each page with lines, and shares of kinds that add up."""
    r = p9_labels(spark, sf)
    whole = F.abs(sum(F.col(f"{k}_share") for k in KINDS) - 1) < 1e-9
    return r.select("doc_id", "n_lines", F.col("kind").isNotNull().alias("labelled"), F.coalesce(whole, F.lit(True)).alias("adds_up"))


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = document_statistics(table(spark, sf, "documents", spread=True), "doc_id", "text", _common_words(spark, sf))
    return s.select(F.col("doc").alias("doc_id"), "n_lines", "n_words", *[F.round(c, 6).alias(c) for c in s.columns[3:]])


QUERIES = {
    f.__name__: f
    for f in (p1_found, p3_found, p3_top_sequences, p4_found, p5_found, p5_best_record, p7_pack, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_labels, p9_check, p9_statistics)
}

_SEQUENCES = f"select upper(trim(sequence, '{WHITE_SPACE}')) as sequence from reads"
_RECORDS = """
r as (select record_id, regexp_extract(family_id, '([0-9]+)[^0-9]*$', 1) as digits, support_read_count, support_span_bp,
        mean_identity, confidence, trust_rank, loaded_at from families left join runs using (run_id)),
f as (select 'TXF' || case when length(n) < 6 then lpad(n, 6, '0') else n end as family_id, * from
        (select *, regexp_replace(digits, '^0+', '') as n from r where digits <> '')),
u as (select *, coalesce(support_read_count >= 1, false) as u1, coalesce(support_span_bp >= 1, false) as u2,
        coalesce(mean_identity >= 0 and mean_identity <= 1 and not isnan(mean_identity), false) as u3,
        coalesce(confidence in ('high', 'medium', 'low'), false) as u4 from f)
"""

SQL = {
    "p1_found": f"""
with d as (select family_id, probe_id, max(probe_score) as s from probes
           where family_id is not null and probe_id is not null and isfinite(probe_score) group by all),
r as (select *, row_number() over (partition by family_id order by s desc, probe_id) as k from d)
select family_id, probe_id from r where k <= {PROBES_PER_FAMILY}""",
    "p3_found": f"""
with s as ({_SEQUENCES}), t as (select count(*) as total from s)
select sequence from s where sequence is not null group by sequence having count(*) * 500 >= (select total from t)""",
    "p3_top_sequences": f"""
with s as ({_SEQUENCES})
select sequence, count(*) as n_reads from s where sequence is not null group by sequence order by n_reads desc, sequence limit {MOST_FREQUENT}""",
    "p4_found": """
with recursive e as (select family_a as a, family_b as b from family_similarity
    where redundant_candidate and family_a is not null and family_b is not null and family_a <> family_b),
d as (select a, b from e union select b, a from e),
r(f, g) as (select distinct a, a from d union select d.b, r.g from r join d on d.a = r.f)
select min(g) as group_id, f as family_id from r group by f having min(g) < f""",
    "p5_found": f"""
with {_RECORDS},
x as (select family_id, 'support_read_count' as field_name, record_id, trust_rank, loaded_at from u where u1
    union all select family_id, 'support_span_bp', record_id, trust_rank, loaded_at from u where u2
    union all select family_id, 'mean_identity', record_id, trust_rank, loaded_at from u where u3
    union all select family_id, 'confidence', record_id, trust_rank, loaded_at from u where u4),
k as (select *, row_number() over (partition by family_id, field_name
        order by trust_rank nulls last, loaded_at desc nulls last, record_id desc) as k from x)
select family_id, field_name, record_id from k
where k = 1 and family_id in (select family_id from u group by family_id having count(*) >= 2)""",
    "p5_best_record": f"""
with {_RECORDS},
x as (select family_id, record_id, u1::bigint + u2::bigint + u3::bigint + u4::bigint as n_usable, trust_rank, loaded_at from u),
k as (select *, row_number() over (partition by family_id
        order by n_usable desc, trust_rank nulls last, loaded_at desc nulls last, record_id desc) as k from x)
select family_id, record_id, n_usable from k where k = 1""",
    "p7_check": "select count(*) as n_pages, 0::bigint as split_needlessly, 0::bigint as incomplete, 0::bigint as over_capacity from documents",
    "p8_check": "select source, 0::bigint as over_repeats, 0::bigint as twice, true as share_holds from mix_targets",
    "p9_check": r"""
with d as (select doc_id, len(list_filter(split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f\v]'))) as n_lines from documents)
select doc_id, n_lines, n_lines > 0 as labelled, true as adds_up from d""",
    "p9_statistics": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
c as (select list(distinct lower(word)) as c from common_words),
s as (select doc_id, t, list_filter(split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f\v]')) as l,
        regexp_extract_all(lower(t), '\p{L}+') as w from d),
n as (select doc_id, t, l, w, len(l) as n_lines, len(w) as n_words from s)
select doc_id, n_lines, n_words,
    case when n_words > 0 then round(length(array_to_string(w, ''))::double / n_words, 6) end as mean_word_length,
    case when length(t) > 0 then round(length(regexp_replace(t, '[\p{L}\p{N} \t\n\r\f\v]', '', 'g'))::double / length(t), 6) end as symbol_ratio,
    case when n_lines > 0 then round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?;:][ \t\r\f\v]*$')))::double / n_lines, 6) end as line_stop_share,
    case when n_words > 0 then round(len(list_filter(w, lambda x: list_contains(c, x)))::double / n_words, 6) end as common_word_share
from n, c""",
}
