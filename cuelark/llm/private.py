"""Personal data, and the words around it that give it away.

1. E-mail addresses, IP addresses, card and phone numbers are listed with their positions; each
   distinct value is a protected entity, and up to ``WORDS`` words on either side of it, within
   ``REACH`` code points, are its context.
2. Counts over the whole corpus say how much a word reveals. With p(e|t) the share of the
   occurrences of word t that lie in the context of entity e, and p(e) the share of all words that
   do, the pointwise mutual information of t and e is log2(p(e|t) / p(e)); e itself carries
   -log2 p(e) bits. What stays hidden from a reader who knows t is their difference, -log2 p(e|t).
3. In the context of e, a word that leaves at most ``REMOVE`` bits hidden is removed, and one that
   leaves at most ``GENERALISE`` bits is generalised to its class. ``UNSEEN`` occurrences
   elsewhere are added to every word's count, so that one sighting alone never removes a word.

Everything is a DataFrame expression. Texts are read where they lie; only matches, context words
and counts are shuffled. Words away from any personal data stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

# Kinds in their order. The patterns find what the plain ones do: possessive
# repeats and look-behinds only keep long runs of one class from being tried at every start.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A text can hold a finding of a kind only if this matches; cheaper than listing matches.
GATES = ("@[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9][\x20().0-9-]")
WORDS, REACH = 8, 160
REMOVE, GENERALISE, UNSEEN = 1.0, math.log2(3), 2
#: Words of a context; anything around an @ is no word.
TOKEN = r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.@-]*|[\p{L}\p{M}]+"


def gate(text: Column) -> Column:
    out = F.lit(False)
    for pattern in GATES:
        out = out | text.rlike(pattern)
    return out


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right counts twice, nines cast out."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    number = digits(value)
    size = F.length(number)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, size.between(14, 19) & luhn(number)).otherwise(size.between(10, 15))


def matches(docs: DataFrame) -> DataFrame:
    """(blob, kind, start, stop, entity, left, right, copies) of valid matches in (blob, text); code points, stop exclusive.

    Matches are leftmost and non-overlapping per kind; a failing one still consumes its characters.
    Equal texts count as ``copies``. ``left`` and ``right`` hold the text around, without a word that was cut.
    """
    lists = []
    for no, (pattern, test) in enumerate(zip(PATTERNS, GATES)):
        gaps = F.split("text", pattern, -1)
        wholes = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found = F.transform(
            F.arrays_zip(F.slice(gaps, 1, F.size(wholes)).alias("gap"), wholes.alias("whole"), F.slice(gaps, 2, F.size(wholes)).alias("next")),
            lambda m: F.struct(
                F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("whole"), m["whole"].alias("value"),
                F.when(F.length(m["gap"]) > REACH, F.regexp_replace(F.substring(m["gap"], -REACH, REACH), r"^\S+", "")).otherwise(m["gap"]).alias("left"),
                F.when(F.length(m["next"]) > REACH, F.regexp_replace(F.substring(m["next"], 1, REACH), r"\S+$", "")).otherwise(m["next"]).alias("right"),
            ),
        )
        lists.append(F.when(F.col("text").rlike(test), F.struct(F.lit(no).alias("kind"), found.alias("found"))))
    each = docs.filter(gate(F.col("text"))).select("blob", F.explode(F.array(*lists)).alias("list")).filter("list is not null")
    rows = each.select("blob", "list.kind", F.posexplode("list.found").alias("pos", "m")).groupBy("blob", "kind", "pos", "m").agg(F.count(F.lit(1)).alias("copies"))
    run = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col("m.value")
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == 0, F.lower(value)).when(F.col("kind") == 1, value).otherwise(digits(value)))
    return (
        rows.withColumn("stop", F.sum((F.col("m.gap") + F.col("m.whole")).cast("long")).over(run))
        .filter(valid(F.col("kind"), value))
        .select("blob", "kind", (F.col("stop") - F.col("m.whole")).alias("start"), "stop", entity.alias("entity"), "m.left", "m.right", "copies")
    )


def _words(text: Column, origin: Column) -> Column:
    """Array of (word, start, stop) of a short text that begins at ``origin``."""
    words, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    before = lambda i: F.aggregate(F.slice(F.arrays_zip(gaps.alias("g"), words.alias("w")), 1, i), F.lit(0), lambda s, x: s + F.length(x["g"]) + F.length(x["w"]))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (origin + before(i) + F.length(F.get(gaps, i))).alias("start")))
    return F.transform(F.filter(placed, lambda x: ~x["word"].contains("@")), lambda x: F.struct(x["word"], x["start"], (x["start"] + F.length(x["word"])).alias("stop")))


def contexts(found: DataFrame) -> DataFrame:
    """(blob, entity, term, start, stop, copies): each occurrence of a word near an entity, once an entity."""
    left = _words(F.col("left"), F.col("start") - F.length("left"))
    right = _words(F.col("right"), F.col("stop"))
    # letters that touch the match belong to a word that it cut
    left, right = F.filter(left, lambda w: w["stop"] < F.col("start")), F.filter(right, lambda w: w["start"] > F.col("stop"))
    near = F.concat(F.slice(F.reverse(left), 1, WORDS), F.slice(right, 1, WORDS))
    return found.select("blob", "entity", "copies", F.explode(near).alias("w")).select("blob", "entity", F.lower("w.word").alias("term"), "w.start", "w.stop", "copies").distinct()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how often each word occurs in all texts."""
    return docs.select(F.explode(F.split("text", r"[^\p{L}\p{M}]+")).alias("word")).filter("word <> ''").groupBy(F.lower("word").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def disclosures(near: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, entity, kind, hidden): the words that leave at most ``GENERALISE`` bits of an entity hidden; kind 4 is generalised, 5 removed."""
    pairs = near.groupBy("term", "entity").agg(F.sum("copies").alias("together"))
    each = pairs.join(corpus.hint("merge"), "term")
    hidden = -F.log2(F.col("together") / (F.greatest("n", "together") + UNSEEN))
    # a little more than the threshold: a logarithm of an exact power of two may be rounded up
    slack = 1e-9
    return each.withColumn("hidden", hidden).filter(F.col("hidden") <= GENERALISE + slack).select("term", "entity", F.when(F.col("hidden") <= REMOVE + slack, 5).otherwise(4).alias("kind"), "hidden")


def evidence(near: DataFrame, corpus: DataFrame) -> DataFrame:
    """:func:`disclosures` with the bits that an entity carries (``information``) and that the word gives away (``pmi``)."""
    total = F.broadcast(corpus.agg(F.sum("n").alias("all")))  # one row
    own = near.groupBy("entity").agg(F.sum("copies").alias("around"))
    rows = disclosures(near, corpus).join(own, "entity").join(total)
    return rows.withColumn("information", -F.log2(F.col("around") / F.col("all"))).withColumn("pmi", F.col("information") - F.col("hidden")).drop("around", "all")


def address(docs: DataFrame, text: str = "text") -> tuple[Column, Column]:
    """Key of a row's text, and the text, null being empty. Only texts that can hold a finding share keys; others never meet a finding."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.when(gate(body), F.sha2(body, 256)).otherwise(F.concat(F.lit("-"), F.xxhash64(body, *[F.col(f"`{c}`") for c in docs.columns if c == "doc_id"]).cast("string"))), body


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``found``: an array of (start, kind, stop), ordered by start, then kind (a place in ``KINDS``).

    A null text is empty; rows that repeat are judged alike, and count as often as they occur. A
    column named found is replaced; an empty table gives no rows.
    """
    key, body = address(docs)
    texts = docs.select(key.alias("blob"), body.alias("text"))
    found = keep(matches(texts), "matches")
    near = keep(contexts(found), "contexts")
    told = near.join(disclosures(near, corpus_counts(texts)), ["term", "entity"]).groupBy("blob", "start", "stop").agg(F.max("kind").alias("kind"))
    spans = found.select("blob", "start", "kind", "stop").unionByName(told.select("blob", "start", "kind", "stop"))
    by_blob = keep(spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("found")), "found")
    rows = docs.drop("found").withColumn("_blob", key)
    out = rows.join(by_blob.withColumnRenamed("blob", "_blob").hint("merge"), "_blob", "left").drop("_blob")
    return out.withColumn("found", F.coalesce("found", F.array().cast(by_blob.schema["found"].dataType)))


def spelled(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    # only what the result needs crosses the join
    narrow = scan(docs.select("doc_id", "text"))
    count = lambda no: F.size(F.filter("found", lambda s: s["kind"] == no)).cast("long").alias(f"n_{KINDS[no]}")
    base = F.filter("found", lambda s: s["kind"] < 4)
    return narrow.select("doc_id", *map(count, range(4)), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten: personal data by its kind, generalised words by their class, removed words by nothing.

    A word's class is ``[Name]`` if it has a capital letter, else ``[word]``. Overlapping spans
    become one, called after the first. A null text stays null.
    """
    rows = scan(docs)
    text = F.col("text")

    def mark(s: Column) -> Column:
        said = F.substr(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]])
        return F.when(s["kind"] < 4, F.get(kinds, s["kind"])).when(s["kind"] == 5, "").when(said != F.lower(said), "[Name]").otherwise("[word]")

    done = F.aggregate(
        "found",
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), mark(s)))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["stop"]).alias("at"),
        ),
    )
    new = F.when(F.size("found") > 0, F.concat(F.array_join(done["out"], ""), F.substr(text, (done["at"] + 1).cast("int")))).otherwise(text)
    return rows.withColumn("text", new).select(*docs.columns)
