"""The operators of this subpackage as queries over the tables `documents` and `benchmark`, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, avi, centroids, decontam, gru, langid, licenses, lines, mixing, pieces, pii, secrets, simhash, spans

Query = Callable[[SparkSession, str], DataFrame]


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pieces.encode_pieces(_documents(spark, sf_dir).select("doc_id", "text"), _model_path())
    return piece_digests(docs)


def piece_digests(docs: DataFrame) -> DataFrame:
    """Of encoded documents: how many ids, and the digests of ids and decoded text."""
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return docs.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("piece_text", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.identify_language(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    accepted = (F.col("language") != langid.UNKNOWN) & (F.col("probability") >= langid.ENOUGH)
    return docs.select("doc_id", "language", F.round("probability", 6).alias("probability"), "text_language", accepted.alias("accepted"))


def op3_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = avi.read_films(avi.store_as_film(_documents(spark, sf_dir).select("doc_id", "text")))
    clip = F.transform("clips", lambda c: F.format_string("%.3f-%.3f:%.2f", c["start_s"], c["end_s"], c["mean_sample"]))
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(clip, ",").alias("feature"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.find_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    counts = [spans.count_of("secrets", k).alias(f"n_{k}") for k in secrets.KINDS[: secrets.BASE]]
    return docs.select("doc_id", *counts, F.sha2(spans.joined(spans.base_only("secrets")), 256).alias("base_sha256"), spans.joined(F.col("secrets")).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "licenses.*")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *[F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_texts(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_personal_data(_documents(spark, sf_dir).select("doc_id", "text"))
    counts = [spans.count_of("personal_data", k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]]
    return docs.select("doc_id", *counts, F.sha2(spans.joined(spans.base_only("personal_data")), 256).alias("base_sha256"), spans.joined(F.col("personal_data")).alias("spans"), spans.scores("personal_data").alias("scores"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.find_contamination(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return docs.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"), F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.drop_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_motion_jpeg": op3_motion_jpeg,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_language_model": op6_language_model,
    "op7_personal_data": op7_personal_data,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroids": op12_centroids,
    "op13_source_mix": op13_source_mix,
    "pipeline": pipeline,
}

#: DuckDB SQL for the queries that it can express.
SQL: dict[str, str] = {
    "op10_line_dedup": r"""
        with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        numbered as (select doc_id, unnest(range(1, len(parts) + 1)) as pos, unnest(parts) as line from docs),
        keyed as (select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from numbered),
        gone as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        marked as (select k.*, g.key is not null and g.keeper <> k.doc_id as dropped from keyed k left join gone g on k.key = g.key)
        select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
        from marked group by doc_id""",
    "op9_decontamination": r"""
        with docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
        items as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
        sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
        windows as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as s from sized)),
        sizes as (select distinct n from windows),
        grams as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, sizes where len(w) >= n)),
        found as (select doc_id, s, g.n, item_id from grams g join windows x on g.n = x.n and g.g = x.g),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from found) group by doc_id),
        named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
        select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs d left join hit using (doc_id) left join named using (doc_id)""",
    "op11_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
        firsts as (select t, min(doc_id) as m from d group by t),
        said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
        masked as (select d.doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t))::int
            + 8 * regexp_matches(d.t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > m, false)::int as mask from d join firsts f on d.t = f.t),
        cells as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from masked left join said using (doc_id) group by part, mask),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
            where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
        steps as (select filter_order, s.step, (1 << (ascii(filter_order[s.step]) - 65)) as own, coalesce(list_sum(list_transform(range(1, s.step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::int as before
            from orders, (select unnest(range(1, 6)) as step) s),
        told as (select part, filter_order, step, own, coalesce(sum(n) filter (where mask & (own | before) = 0), 0) as kept, coalesce(sum(n) filter (where mask & before = 0 and mask & own <> 0), 0) as removed,
            coalesce(sum(n) filter (where mask & before <> 0 and mask & own <> 0), 0) as redundant, coalesce(sum(n) filter (where mask = own), 0) as unique_fails,
            coalesce(sum(good) filter (where mask & before = 0 and mask & own <> 0), 0) as good_lost, coalesce(sum(toxic) filter (where mask & before = 0 and mask & own <> 0), 0) as toxic_lost
            from cells, steps group by part, filter_order, step, own)
        select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
            toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from told""",
    "op12_centroids": """
        with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as (select (row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1)::int as c, v as m from kept qualify c < 16),"""
    + ",".join(f"""
        a{r} as (select vec_id, v, c, d from (select vec_id, v, c, list_sum(list_transform(range(1, 65), lambda k: (v[k] - m[k]) * (v[k] - m[k]))) as d from kept, c{r}) qualify row_number() over (partition by vec_id order by d, c) = 1),
        s{r} as (select c, pos, sum(v[pos])::bigint as t, count(*) as n from a{r}, (select unnest(range(1, 65)) as pos) group by c, pos),
        c{r + 1} as (select c{r}.c, coalesce(u.m, c{r}.m) as m from c{r} left join (select c, list((t - ((t % n) + n) % n) // n order by pos) as m from s{r} group by c) u on u.c = c{r}.c)""" for r in range(3))
    + """,
        a3 as (select vec_id, c, d from (select vec_id, c, list_sum(list_transform(range(1, 65), lambda k: (v[k] - m[k]) * (v[k] - m[k]))) as d from kept, c3) qualify row_number() over (partition by vec_id order by d, c) = 1)
        select vec_id, a3.c as cluster, d::bigint as distance, (sum(d) over (partition by a3.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a3 join c3 on a3.c = c3.c""",
    # Sources of up to mixing.SHARD words and rows, which have one shard each.
    "op13_source_mix": r"""
        with recursive d as (select doc_id, source, coalesce('s' || source, 'n') as skey, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
            sha256('13:' || coalesce(doc_id::varchar, '-' || sha256(coalesce(text, '')))) as drawn from documents),
        sources as (select skey, any_value(source) as source, sum(size)::bigint as words, count(*) as n, row_number() over (order by any_value(source) is null, any_value(source)) as place from d group by skey),
        weighed as (select *, ([5, 2, 1])[(place - 1) % 3 + 1] as weight from sources),
        totals as (select sum(words)::bigint as words, sum(weight)::bigint as weight from weighed),
        rates as (select 0 as step, case when words > 0 then 1.5::double * words / weight else 0::double end as rate from totals
            union all
            select step + 1, (select (1.5::double * t.words - coalesce(sum(2 * w.words) filter (where w.weight * rate > 2 * w.words), 0)::bigint) / (sum(w.weight) filter (where w.weight * rate <= 2 * w.words))::bigint from weighed w, totals t group by t.words)
            from rates where step < 60),
        aimed as (select w.*, least(weight * rate, (2 * words)::double) as target from weighed w, (select rate from rates order by step desc limit 1) where rate is not null),
        blocks as (select coalesce(max(b), 1) as b from (select unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) as b), (select min(target) as least from aimed where target > 0) where 64 * b <= least),
        seats as (select floor(1.5::double * words / b + 0.5)::bigint as n, b from totals, blocks),
        won as (select skey, count(*) as quota from (select skey, target / (2 * s + 1) as q, place from (select skey, target, place, unnest(range(0, (2 * words // b + 2)::bigint)) as s from aimed, seats where target > 0)
            qualify row_number() over (order by q desc, place) <= (select n from seats)) group by skey),
        laid as (select d.*, a.words, a.target, coalesce(quota, 0) as quota, coalesce(sum(size) over (partition by d.skey order by drawn, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
            from d join aimed a using (skey) left join won using (skey)),
        taking as (select *, least(quota * b, 2 * words)::bigint as takes from laid, blocks)
        select doc_id, size, words as source_size, target, (greatest(0, least(takes - before, size)) + greatest(0, least(takes - words - before, size)))::bigint as taken from taking""",
}
