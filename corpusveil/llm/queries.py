"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, rollups, sampling
from .centroids import clusters
from .common import cut, fresh_dir, scratch, table
from .html import extract
from .jpeg import features, read_media, write_media
from .langid import identify
from .middle import fill_in_middle, restored
from .minhash import near_duplicates
from .packing import pack
from .quality import judged
from .records import read_records, write_records
from .toxicity import score


def tokenizer(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("k", "page_id")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_records(table(spark, sf_dir, "documents"), tokenizer=tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=1)
    return read_records(spark, root).withColumnRenamed("k", "doc_id")


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with one tokenizer's counts; then those of under five tokens go, the others' counts are revised to hold an end id, a second tokenizer's counts come in, and that batch is committed twice."""
    root = fresh_dir(spark, "rollups")
    files = {"word_bpe_49k": (tokenizer("word_bpe_49k.json"), False), "byte_bpe_50k": (tokenizer("byte_bpe_50k.json"), True)}
    with scratch(spark):
        counts = cut(rollups.token_counts(table(spark, sf_dir, "documents"), files), "counts")
        commits(root, counts, "word_bpe_49k", "byte_bpe_50k")
    return rollups.totals(spark, root)


def commits(root: str, counts: DataFrame, first: str, second: str) -> None:
    """The two batches of a query on rollups, of which the second comes twice; `counts` has a column for each of two versions."""
    old = F.col(first)
    rollups.commit(root, "1", counts.select("source", "lang", F.lit(first).alias("version"), F.lit("insert").alias("op"), old.alias("tokens"), F.lit(None).cast("long").alias("old_tokens")))
    change = F.explode(F.array(
        F.struct(F.lit(first).alias("version"), F.when(old < 5, "delete").otherwise("revise").alias("op"), F.when(old < 5, old).otherwise(old + 1).alias("tokens"), old.alias("old_tokens")),
        F.struct(F.lit(second).alias("version"), F.lit("insert").alias("op"), F.col(second).alias("tokens"), F.lit(None).cast("long").alias("old_tokens")),
    ))
    for _ in range(2):
        rollups.commit(root, "2", counts.select("source", "lang", change.alias("c")).select("source", "lang", "c.*"))


def word_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with counts that SQL can make: words, and runs of letters, digits and other signs; compacted before the second batch's repeat."""
    root = fresh_dir(spark, "rollups")
    count = lambda pattern: F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(pattern)), F.lit(0)).cast("long")
    with scratch(spark):
        counts = cut(table(spark, sf_dir, "documents").select("source", "lang", count(r"[^\x20\x09-\x0D]+").alias("words-1"), count(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]").alias("pieces-2")), "counts")
        commits(root, counts, "words-1", "pieces-2")
        rollups.compact(spark, root)
        commits(root, counts, "words-1", "pieces-2")
    return rollups.totals(spark, root)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return groups.select(F.col("k").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("k", "doc_id")


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.digests(table(spark, sf_dir, "documents"), model=tokenizer("piece_bpe_32k.model")).withColumnRenamed("k", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2, large=True)
    return packed.withColumnRenamed("k", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("k", "doc_id")


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = features(read_media(write_media(table(spark, sf_dir, "documents"))))
    first = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return decoded.select(F.col("k").alias("doc_id"), *first, "height", "width", "rgb")


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector of `embeddings` with its cluster after ten rounds; see `clusters`."""
    return clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("k", "vec_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's form and of the text restored from it; see `fill_in_middle`."""
    formed = fill_in_middle(table(spark, sf_dir, "documents"))
    return formed.select(F.col("k").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))


def op13_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; see `copies`."""
    return mixing.copies(table(spark, sf_dir, "documents")).select(F.col("k").alias("doc_id"), "size", "source_size", "target", "taken", F.col("s").alias("source"), "copies")


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each source, without the draws, so that SQL can tell."""
    with scratch(spark):
        sizes = mixing.sizes(table(spark, sf_dir, "documents"))
        return mixing.targets(sizes.groupBy("s").agg(F.sum("size").alias("source_size"))).select(F.col("s").alias("source"), "source_size", "weight", "target")


_WORDS = r"string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')"

_UNITS = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"


def _clusters_sql() -> str:
    """Ten rounds as ten steps: distances to all centroids, the smallest, and means rounded down."""
    assign = "select k, c, d from (select k, c, d, row_number() over (partition by k order by d, c) as i from (select k, c, list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x, c{n}) q) q where i = 1"
    steps = []
    for n in range(11):
        steps.append(f"a{n} as materialized ({assign.format(n=n)})")
        if n < 10:
            sums = f"select c, p, sum(v[p])::bigint as s, count(*) as m from (select c, v, unnest(range(1, 65)) as p from a{n} join x using (k)) q group by c, p"
            steps.append(f"c{n + 1} as materialized (select c, coalesce(w, u) as u from c{n} left join (select c, list((s - ((s % m) + m) % m) // m order by p) as w from ({sums}) q group by c) q using (c))")
    return f"""with x as materialized (select vec_id as k, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
        c0 as materialized (select row_number() over (order by h) - 1 as c, u from (select sha256(concat('3:', k)) as h, v as u from x order by h limit 8) q),
        {", ".join(steps)},
        s as (select c, sum(d)::bigint as cluster_inertia from a10 group by c)
        select k as vec_id, c::int as cluster, d as distance, cluster_inertia, (select sum(d)::bigint from a10) as inertia, sha256(array_to_string(u, ',')) as centroid_sha256 from a10 join s using (c) join c10 using (c)"""


ORACLES: dict[str, str] = {
    "op11_annulus_clusters": _clusters_sql(),
    "op12_fill_in_middle": rf"""
        with d as (select doc_id, coalesce(text, '') as t, sha256(concat('42:', doc_id)) as h from documents),
        u as (select *, {_UNITS} as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
        c as (select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
        p as (select doc_id, t, n, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
               sha256(case form when 'plain' then t when 'spm' then concat('<S>', suffix, '<P>', prefix, '<M>', middle) else concat('<P>', prefix, '<S>', suffix, '<M>', middle) end) as output_sha256, sha256(t) as restored_sha256 from p""",
    "source_targets": r"""
        with s as (select source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::bigint as source_size from documents group by source),
        w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int as weight from s),
        r as (select *, row_number() over (order by source_size / weight, source nulls last) as i from w),
        b as (select *, sum(source_size) over () - coalesce(sum(3 * source_size) over (order by i rows between unbounded preceding and 1 preceding), 0) as words, sum(weight) over () - coalesce(sum(weight) over (order by i rows between unbounded preceding and 1 preceding), 0) as weights from r),
        f as (select *, words * weight > 3 * source_size * weights as above from b),
        l as (select sum(case when above then -2 * source_size else source_size end) as words, sum(case when above then 0 else weight end) as weights from f)
        select source, source_size, weight, case when above then (3 * source_size)::double else (l.words * weight)::double / l.weights::double end as target from f, l""",
    "word_rollups": r"""
        with c as (select source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as words,
                          coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')), 0)::bigint as pieces from documents)
        select source, lang, 'words-1' as version, count(*)::bigint as n_docs, sum(words + 1)::bigint as n_tokens from c where words >= 5 group by all
        union all
        select source, lang, 'pieces-2', count(*)::bigint, sum(pieces)::bigint from c group by all""",
    "op4_host_rules": rf"""
        with w as (select doc_id, source, coalesce(text, '') as t, list_filter({_WORDS}, lambda x: x <> '') as words from documents),
        windows as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as x
                    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
        twice as (select doc_id, x from windows group by doc_id, x having count(*) > 1),
        covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from windows join twice using (doc_id, x)) group by doc_id),
        m as (select doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                     (select (count(*) - count(distinct l))::bigint from (select unnest(string_split(t, chr(10))) as l) where regexp_matches(l, '[^ 	-
]')) as n_dup_lines,
                     coalesce(n, 0)::bigint as n_repeat_words
              from w left join covered using (doc_id)),
        f as (select *, (n_words < 50)::int as short, (100 * n_repeat_words > 50 * n_words)::int as repetitive,
                     (n_symbols > n_words)::int as symbols, (word_chars < 2 * n_words or word_chars > 15 * n_words)::int as word_length from m),
        h as (unpivot (select source, count(*) as n, sum(short) as short, sum(repetitive) as repetitive, sum(symbols) as symbols, sum(word_length) as word_length from f group by source)
              on short, repetitive, symbols, word_length into name rule value fails),
        p as (select rule, avg(fails / n) as mean, coalesce(var_samp(fails / n), 0) as var from h group by rule),
        r as (select source, max((fails + weight * mean) / (n + weight)) as rate
              from (select h.*, mean, case when var > 0 and var < mean * (1 - mean) then mean * (1 - mean) / var - 1 else 1 end as weight from h join p using (rule)) group by source)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short + repetitive > 0) as base_failed, (short + repetitive = 0 and rate <= 0.5) as kept
        from f join r on f.source is not distinct from r.source""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"word_rollups": word_rollups, "source_targets": source_targets}
