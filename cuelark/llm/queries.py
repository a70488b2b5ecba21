"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, divergence, lattice, licenses, merkle, neardup, packing, private, secrets, toxicity, vectors, winnow
from .common import shared_dir, table


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op3_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op5_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans the documents into the ledger of ``cuelark.ledger`` (else a new one), and once more: the second scan finds no unseen blob, its findings come from the ledger."""
    versions = secrets.address(table(spark, sf_dir, "documents"), "doc_id", "text")
    ledger = secrets.Ledger(spark, spark.conf.get("cuelark.ledger", None) or f"{shared_dir(spark)}/cuelark/{uuid.uuid4().hex}/ledger")
    ledger.scan(versions)
    if ledger.scan(versions):
        raise RuntimeError("the ledger lost blobs")
    return secrets.digest(secrets.on_paths(versions, ledger.findings()))


def op7_grid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top directory, the language the one below it."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "*")


def replayed(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as the events that could have made them.

    By its place in the conversation a turn is streamed in two deltas, started wrongly and
    regenerated, or sent as its first half and then edited. Turns follow by turn, role and text.
    """
    body, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    left, right = F.substr(body, F.lit(1), half), F.substr(body, half + 1)
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    streamed = F.array(event("delta", left), event("delta", right))
    regenerated = F.array(event("delta", F.lit("No, ")), event("delta", right), event("regenerate", left), event("delta", right))
    edited = F.array(event("message", left), event("edit", body))
    events = F.when(F.col("place") % 3 == 0, streamed).when(F.col("place") % 3 == 1, regenerated).otherwise(edited)
    rows = turns.withColumn("place", place).select("conv_id", F.col("place").alias("message_id"), "role", F.posexplode(events).alias("step", "event"))
    role = F.when(F.col("step") == 0, F.col("role"))
    return rows.select("conv_id", (F.col("message_id") * 4 + F.col("step")).alias("seq"), "message_id", "event.kind", role.alias("role"), "event.text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds whole turns; they're replayed as events, so that the fold makes every message of the output."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat.digest(chat.format_conversations(replayed(turns.unionByName(probe))))


def op11_term_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.spans_of(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lattice_score": op1_lattice_score,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_block_max_toxicity": op3_block_max_toxicity,
    "op4_winnow": op4_winnow,
    "op5_harmonic_pack": op5_harmonic_pack,
    "op6_secret_scan": op6_secret_scan,
    "op7_grid_vectors": op7_grid_vectors,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op10_lsh_forest": op10_lsh_forest,
    "op11_term_tiles": op11_term_tiles,
    "op12_disclosure": op12_disclosure,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Matches per rule as lists of the texts between them and of themselves; positions are running sums of lengths."""
    each = []
    for no, (kind, pattern, group, least) in enumerate(secrets.RULES):
        # this dialect has no possessive repeats; it needs none, for it never goes back
        p = _q(re.sub(r"([*+}])\+", r"\1", pattern))
        each.append(
            f"select doc_id, {no} as rule, '{kind}' as kind, {least} as least, unnest(gaps) as gap, unnest(wholes) as whole, unnest(parts) as part, generate_subscripts(gaps, 1) as pos "
            f"from (select doc_id, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}, 0) as wholes, regexp_extract_all(text, {p}, {group}) as parts from d where regexp_matches(text, {p}))"
        )
    spelled = "kind || ':' || stop - length(whole) || ':' || stop"
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE)
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents), m as ({" union all ".join(each)}),
s as (select *, sum(length(gap) + coalesce(length(whole), 0)) over (partition by doc_id, rule order by pos) as stop from m),
f as (select doc_id, rule, kind, stop - length(whole) as start, {spelled} as shown from s where length(part) >= least)
select d.doc_id, {counts}, sha256(coalesce(string_agg(shown, ',' order by start, rule) filter (kind in ({base})), '')) as base_sha256, coalesce(string_agg(shown, ',' order by start, rule), '') as spans
from d left join f on d.doc_id = f.doc_id group by d.doc_id"""


# The contract's patterns of personal data, without possessive repeats.
_PRIVATE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _private_sql() -> str:
    """Matches with the texts between them; words of those texts by running sums of lengths; counts over the corpus."""
    each = " union all ".join(
        f"select r, {no} as kind, gaps[i] as gap, wholes[i] as whole, gaps[i + 1] as next, i as pos from (select r, gaps, wholes, unnest(range(1, len(wholes) + 1)) as i from (select r, string_split_regex(text, {_q(p)}) as gaps, regexp_extract_all(text, {_q(p)}) as wholes from d where regexp_matches(text, {_q(p)})))"
        for no, p in enumerate(_PRIVATE)
    )
    token, reach, words = _q(private.TOKEN), private.REACH, private.WORDS
    luhn = "list_sum(list_transform(range(len(number)), lambda i: case when i % 2 = 1 then number[len(number) - i]::int * 2 // 10 + number[len(number) - i]::int * 2 % 10 else number[len(number) - i]::int end)) % 10 = 0"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: length(t))), 0)"
    kinds = ", ".join(f"'{k}'" for k in private.KINDS)
    counts = ", ".join(f"count(*) filter (kind = {no}) as n_{private.KINDS[no]}" for no in range(4))
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), m as ({each}),
s as (select *, sum(length(gap) + length(whole)) over (partition by r, kind order by pos) as stop, regexp_replace(whole, '[^0-9]', '', 'g') as number from m),
f as (select r, kind, stop - length(whole) as start, stop, kind || ':' || case kind when 0 then lower(whole) when 1 then whole else number end as entity,
    case when length(gap) > {reach} then regexp_replace(right(gap, {reach}), '^\\S+', '') else gap end as l, case when length(next) > {reach} then regexp_replace(left(next, {reach}), '\\S+$', '') else next end as t
  from s where case kind when 0 then true when 1 then list_bool_and(list_transform(string_split(whole, '.'), lambda x: coalesce(try_cast(x as bigint) <= 255, false))) when 2 then length(number) between 14 and 19 and {luhn} else length(number) between 10 and 15 end),
sides as (select r, kind, start, stop, entity, 0 as side, start - length(l) as origin, regexp_extract_all(l, {token}) as w, string_split_regex(l, {token}) as g from f
  union all select r, kind, start, stop, entity, 1, stop, regexp_extract_all(t, {token}), string_split_regex(t, {token}) from f),
w as (select *, w[i] as word, origin + {size("g[1:i]")} + {size("w[1:i - 1]")} as a from (select *, unnest(range(1, len(w) + 1)) as i from sides)),
near as (select distinct r, entity, lower(word) as term, a, a + length(word) as z from (select *, row_number() over (partition by r, kind, start, side order by case side when 0 then -i else i end) as k from w where not contains(word, '@') and case side when 0 then a + length(word) < start else a > stop end) where k <= {words}),
n as (select lower(x) as term, count(*) as n from (select unnest(string_split_regex(text, '[^\\p{{L}}\\p{{M}}]+')) as x from d) where x <> '' group by 1),
told as (select term, entity, case when hidden <= {private.REMOVE} + 1e-9 then 5 else 4 end as kind from (select term, entity, -log2(count(*) / (greatest(any_value(n), count(*)) + {private.UNSEEN}.0::double)) as hidden from near join n using (term) group by term, entity) where hidden <= {private.GENERALISE!r}::double + 1e-9),
spans as (select r, kind, start, stop from f union all select r, max(kind), a, z from near join told using (term, entity) group by r, a, z),
shown as (select *, list_extract([{kinds}], kind + 1) || ':' || start || ':' || stop as shown from spans)
select d.doc_id, {counts}, sha256(coalesce(string_agg(shown, ',' order by start, kind) filter (kind < 4), '')) as base_sha256, coalesce(string_agg(shown, ',' order by start, kind), '') as spans
from d left join shown using (r) group by d.r, d.doc_id"""


def _merkle_sql() -> str:
    """Levels of the languages' trees, and of the tree over them, by recursion; folds go up the same way."""
    shown = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda n: "sha256(" + " || ".join(shown(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    codes = "list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
    level = lambda t: f"""select level + 1, g, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by g) as k from {t}) where k > 1 group by level, g, pos // 2"""
    return f"""with recursive d as (select doc_id, coalesce('1' || lang, '0') as g, {leaf("n_chars")} as leaf, case when {crc} % 7 = 0 then {leaf("(n_chars + 1)")} else {leaf("n_chars")} end as forged from documents),
l as (select *, row_number() over (partition by g order by doc_id, leaf) - 1 as pos, count(*) over (partition by g) as n from d),
t(level, g, pos, h) as (select 0, g, pos, leaf from l union all {level("t")}),
s as (select g, arg_max(h, level) as subroot from t group by g),
r as (select '' as g, g as name, subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from s),
u(level, g, pos, h) as (select 0, g, pos, subroot from r union all {level("u")}),
top as (select arg_max(h, level) as root from u),
lower_path as (select l.g, l.pos, string_agg(t.h, '' order by t.level) as path from l join t on t.g = l.g and t.pos = xor(l.pos >> t.level, 1) group by all),
upper_path as (select r.name as g, string_agg(u.h, '' order by u.level) as path from r join u on u.pos = xor(r.pos >> u.level, 1) group by all),
f(g, leaf_pos, level, pos, n, h) as (select g, pos, 0, pos, n, forged from l
  union all select f.g, leaf_pos, f.level + 1, f.pos // 2, (f.n + 1) // 2, sha256(case when f.pos % 2 = 1 then t.h || f.h else f.h || coalesce(t.h, '') end) from f left join t on t.g = f.g and t.level = f.level and t.pos = xor(f.pos, 1) where f.n > 1),
e(g, leaf_pos, level, pos, n, h) as (select f.g, f.leaf_pos, 0, r.pos, r.n, f.h from f join r on r.name = f.g where f.n = 1
  union all select e.g, leaf_pos, e.level + 1, e.pos // 2, (e.n + 1) // 2, sha256(case when e.pos % 2 = 1 then u.h || e.h else e.h || coalesce(u.h, '') end) from e left join u on u.level = e.level and u.pos = xor(e.pos, 1) where e.n > 1)
select l.doc_id, l.leaf, s.subroot, top.root, sha256(coalesce(p.path, '') || coalesce(q.path, '')) as proof_sha256, e.h as folded_root, e.h = top.root as verified
from l join s using (g) cross join top left join lower_path p on p.g = l.g and p.pos = l.pos left join upper_path q on q.g = l.g join e on e.g = l.g and e.leaf_pos = l.pos and e.n = 1"""


_ESCAPED = "replace(replace(replace({x}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')"

ORACLES: dict[str, str] = {
    "op6_secret_scan": _secrets_sql(),
    "op7_grid_vectors": """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join l on r.b = l.a)
select a as vec_id, (select count(*) from l where l.a = reach.a) as n_links, min(b) as component_id, a = min(b) as kept from reach group by a""",
    "op9_chat_format": f"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {_q(chr(92) + "### Assistant: </turn> ok")} union all select -7, 1, 'assistant', {_q(chr(92) + "### Assistant: </turn> ok")})
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(replace({_ESCAPED.format(x="role")}, chr(10), '\\n')) + 1 + length({_ESCAPED.format(x="text")}) + 8) as bigint) as formatted_chars
from r group by conv_id""",
    "op11_term_tiles": r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 3),
g as (select distinct lang, source from d), c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
v as (select lang, count(*) as v, sum(n) as n from k group by lang), t as (select lang, source, sum(n) as n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v))::bigint as p, (1 + 1000000000::hugeint * (k.n + 1) // (v.n + v.v))::bigint as q
  from g join k using (lang) join v using (lang) left join t using (lang, source) left join c using (lang, source, term)),
pairs as (select lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b using (lang, term) where a.source <> b.source group by all),
found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select * from ranked where part = 'pair' or rank <= 200""",
    "op12_disclosure": _private_sql(),
    "op13_merkle_manifest": _merkle_sql(),
}
