"""The queries of this folder, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import chat, decontaminate, divergence, fim, html_text, langid, packing, secret_scan, suffix_tree, toxicity, warc
from spoorline.llm.embed_dedup import embedding_groups
from spoorline.llm.ngram_join import jaccard_groups
from spoorline.llm.tables import crc_part, table
from spoorline.session import configure, cut, frozen, scratch_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        with stage(spark) as made:
            result = fn(spark, sf_dir)
            # a result that reads stage tables is stored before they go
            return frozen(result) if made.paths else result

    QUERIES[fn.__name__] = run
    return fn


def tokenizer_path() -> str:
    """The public vocabulary that the packing contract names; installed beside the tokenizers on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_part(F.col("doc_id"), 5) == 1)
    model, joined = suffix_tree.learn(docs.where(~F.col("held_out")).select("text"))
    return suffix_tree.score(docs, model, joined, ["doc_id", "held_out"])


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.similarity", "f.first_word", "f.n_words")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs), ["doc_id"])
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.text_of(F.col("base")), 256).alias("base_sha256"),
        secret_scan.text_of(secret_scan.merged(F.col("base"), F.col("added"))).alias("spans"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(table(spark, sf_dir, "pages"), ["page_id"])


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_groups(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_part(F.col("doc_id"), 4) == 2)
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = crc_part(F.col("doc_id"), 4) != 2
    model = toxicity.learn(docs.where(train), labels.where(train))
    scored = toxicity.score(docs.withColumn("held_out", ~train), model, ["doc_id", "held_out"])
    return scored.select("row.*", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns of the conversations written as plain transcripts; a quarter of them is not trained on."""
    lines = chat.plain_transcripts(table(spark, sf_dir, "conversations"))
    model = chat.learn(lines.where(crc_part(F.col("conv_id"), 4) != 2))
    bare = lines.select("conv_id", F.struct("turn", "line_no").alias("at"), "line")
    return chat.canonical_turns(chat.recover_lines(bare, model)).select("conv_id", "first_pos", "role", "n_lines", "rendered")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.rearrange(table(spark, sf_dir, "documents"), ["doc_id"], seed=7)
    return out.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, then finds each capture by its address in the index and reads it back."""
    pages, root = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    index = warc.build_index(warc.write(pages, root, "page_id", "url", "html"), root)
    hits = warc.lookup(spark, index, pages.select("page_id", "url").distinct(), ["page_id"], id_column="page_id")
    payload = F.col("payload")
    read = cut(warc.fetch(hits, root).select(
        "row.page_id", "kind", "name", "digest", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")))
    return warc.resolve(read, "payload_bytes", "payload_digest").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(read.schema["page_id"].dataType).alias("refers_to"))


ORACLES["op11_source_divergence"] = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
w as (select row, lang, source, unnest(t) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by 1, 2 having count(distinct row) >= 3),
langs as (select lang, count(*) as v, sum(n)::hugeint as total from kept group by 1),
groups as (select distinct lang, source from d),
own as (select w.lang, w.source, w.term, count(*)::hugeint as n from w join kept using (lang, term) group by 1, 2, 3),
size as (select lang, source, sum(n)::hugeint as total from own group by 1, 2),
p as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(o.n, 0) + 1) // (coalesce(s.total, 0) + l.v) as p
  from groups g join kept k using (lang) join langs l using (lang) left join size s using (lang, source) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
q as (select k.lang, k.term, 1 + 1000000000::hugeint * (k.n + 1) // (l.total + l.v) as q from kept k join langs l using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= 200
"""

ORACLES["op12_fill_in_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (
  select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (
  select *, len(l) as n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) as a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
s as (
  select *, coalesce(array_to_string(l[1:a], ''), '') as p, coalesce(array_to_string(l[a + 1:b], ''), '') as m, coalesce(array_to_string(l[b + 1:], ''), '') as r from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || r || '<M>' || m else '<S>' || r || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from s
"""

ORACLES["op13_warc"] = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
f as (select html, min(page_id) as first from p where n >= 100 group by html)
select p.page_id, p.n as payload_bytes, sha256(p.html) as payload_digest,
  case when f.first <> p.page_id then 'revisit' else 'response' end as record_type, case when f.first <> p.page_id then f.first end as refers_to
from p left join f on f.html = p.html
"""

ORACLES["op7_ngram_join"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
posts as (select doc_id, len(s) as n, unnest(s) as sh from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as inter, any_value(a.n) as nx, any_value(b.n) as ny
  from posts a join posts b on a.sh = b.sh and a.doc_id < b.doc_id and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90
  group by 1, 2),
links as (select x, y from pairs where 100 * inter >= 90 * (nx + ny - inter)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from sets union select r.x, e.y from reach r join edges e on r.y = e.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.y) as component_id
from sets s join reach r on r.x = s.doc_id group by 1, 2
"""

# links are exact here by comparing all vectors of a label
ORACLES["op6_embedding_dedup"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e,
    embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
links as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.ok and b.ok and a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join links l on r.y = l.x),
low as (select x, min(y) as component_id from reach group by 1),
deg as (select x, count(*) as n from links group by 1)
select v.vec_id, coalesce(deg.n, 0) as n_links, low.component_id, v.vec_id = low.component_id as kept
from v join low on low.x = v.vec_id left join deg on deg.x = v.vec_id
"""
