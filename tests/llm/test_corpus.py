"""Operators over whole corpora against plain Python: source divergence, personal data, Merkle manifests."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("cuelark.llm")
from cuelark.llm import divergence, merkle, private  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, term string, part string, value double"


def documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, odd characters; clashing column names."""
    r = np.random.RandomState(5)
    said = lambda n: " ".join(f"w{'abcdefghij'[r.randint(10)]}{'xyz' * r.randint(3)}" for _ in range(n))
    rows = [(i, said(r.randint(1, 40)), ["en", "de", None, "ça"][i % 4], [None, "a", "b", "", "é"][i % 5], i, "t", "p", 0.1) for i in range(120)]
    rows += [(200, None, "en", "a", None, None, None, None), (201, "", "xx", "only", 3, "t", "p", 0.2), (202, "", "xx", "other", 3, "t", "p", 0.2), (203, "1 2 3 !!", "xx", None, 3, "t", "p", 0.2)]
    rows += [(204, "ÀÉ Straße STRASSE naïve 日本語テキスト 😀 it's e-mail", "fr", "s", 9, "t", "p", 0.3)] * 3
    rows += [(205, "long " * 30_000 + "Tail", "en", "b", 150_004, "t", "p", 0.4), (206, "z" * 50_000, "en", "b", 50_000, "t", "p", 0.4), (None, "no id here", "en", "a", 10, "t", "p", 0.5), (None, None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (3, "another text under id three", "de", "a", 27, "t", "p", 0.6), (2**60 + 7, "a large id", "en", "a", 10, "t", "p", 0.7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SHAPE).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


# ------------------------------------------------------------- divergence of sources


def diverged(rows, least=3, best=200):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        mine = sorted(s for x, s in groups if x == lang)
        every = sum((n[lang, s] for s in mine), Counter())
        p = lambda c: [1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept]
        f = lambda a, b: (a - b) ** 2 // b
        shares, q = {s: p(n[lang, s]) for s in mine}, p(every)
        for s in mine:
            pairs = [(o, sum(map(f, shares[s], shares[o]))) for o in mine if o != s]
            terms = [(t, f(a, b)) for t, a, b in zip(kept, shares[s], q) if n[lang, s][t] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(order[: best if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize(("best", "rows", "tile"), [(200, 256, 65_536), (3, 2, 16)])
def test_divergence_against_brute_force(docs, best, rows, tile):
    got = divergence.divergence(docs, best=best, rows=rows, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == diverged(documents(), best=best)


def test_partial_results_follow_the_terms_and_not_the_shuffles(spark, docs, monkeypatch):
    """Every block hands out pairs and best terms; there were as many blocks as shuffle partitions."""
    assert divergence.n_blocks(0, 0) == 1 and divergence.n_blocks(10**9, 1600) == 125 and divergence.n_blocks(10**9, 10**6) == 1
    made, kept = [], divergence.keep

    def counted(df, name):
        out = kept(df, name)
        if name == "partial":
            made.append(out.count())
        return out

    monkeypatch.setattr(divergence, "keep", counted)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, divergence.divergence(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    monkeypatch.setattr(divergence, "WORK", 1)
    monkeypatch.setattr(divergence, "TERMS", 1)
    found.append(sorted(map(tuple, divergence.divergence(docs).collect())))
    assert made[0] == made[1] < made[2] and found[0] == found[1] == found[2]


def test_divergence_of_nothing(none):
    assert divergence.divergence(none).collect() == []


def test_shares_are_exact():
    r = np.random.RandomState(1)
    whole = r.randint(1, 2**52, 2000)
    count = (whole * r.rand(2000)).astype("int64") + 1
    assert divergence.share(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole)]
    p, q = r.randint(1, 10**9 + 2, 2000), r.randint(1, 10**9 + 2, 2000)
    assert divergence.distance(p, q).tolist() == [(int(a) - int(b)) ** 2 // int(b) for a, b in zip(p, q)]


def test_tasks_pass_counts_on(spark, monkeypatch):
    """Counts that are passed on several times in a task sum to the same."""
    monkeypatch.setattr(divergence, "HELD", 7)
    import pandas as pd

    rows = [(a or "", b or "", t or "") for _, t, a, b, *_ in documents()]
    parts = pd.concat(list(divergence._count([pd.DataFrame(rows[i : i + 9], columns=["lang", "source", "text"]) for i in range(0, len(rows), 9)])))
    monkeypatch.setattr(divergence, "HELD", 10**9)
    whole = pd.concat(list(divergence._count([pd.DataFrame(rows, columns=["lang", "source", "text"])])))
    keys = ["lang", "source", "term"]
    total = lambda x: x.fillna("-").groupby(keys)[["n", "docs"]].sum().sort_index()
    assert len(parts) > len(whole) and total(parts).equals(total(whole))


# ------------------------------------------------------------- manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf the siblings up to it."""
    paths, level, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(i, min(i + 2, len(level))) for i in range(0, len(level), 2)]
        for run in runs:
            for i in run:
                for leaf in under[i]:
                    paths[leaf].append([level[j] for j in run if j != i])
        level, under = [H(*[level[i] for i in run]) for run in runs], [[x for i in run for x in under[i]] for run in runs]
    return level[0], paths


def manifests(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*map(shown, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in of[x]]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for k, r in enumerate(of[x]):
            path = trees[x][1][k] + tops[i]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            out.append((r[0] if r[0] is not None else -1, leaf(r), trees[x][0], root, H(*[h for run in path for h in run]), bad, not bad))
    return sorted(out)


@pytest.mark.parametrize("step", [2, 14])
def test_manifest_against_brute_force(docs, step):
    """Two levels a round take several rounds, and ragged nodes in each."""
    rows = merkle.manifest(docs, step).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root != r.root, r.verified) for r in rows) == manifests(documents())


def test_manifest_of_nothing_and_of_one(spark, docs, none):
    assert merkle.manifest(none).collect() == []
    one = merkle.manifest(docs.filter("doc_id = 205")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 65])
def test_fold_and_subtree(n):
    leaves = [H(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    one = merkle.Subtree(n, 14)
    one.levels[0] = dict(enumerate(leaves))
    one.build()
    for i, path in enumerate(paths):
        level, at, met = one.path(0, i)
        assert one.levels[level][at] == root and at == 0 and met == "".join(h for run in path for h in run)
        assert merkle.fold(leaves[i], i, n, met) == root and (n == 1 or merkle.fold(H("x"), i, n, met) != root)


# ------------------------------------------------------------- personal data

# the contract's patterns
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    number = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(number) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0
    return kind == "email" or 10 <= len(number) <= 15


def plain_matches(text):
    """(start, kind number, stop, entity, left, right) of what passes."""
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        every = list(re.finditer(pattern, text))
        ends = [0, *(m.end() for m in every)]
        starts = [*(m.start() for m in every[1:]), len(text)]
        for m, before, after in zip(every, ends, starts):
            if passes(kind, m[0]):
                left, right = text[before : m.start()], text[m.end() : after]
                left = re.sub(r"^[^ \t\n\r\f\v]+", "", left[-160:]) if len(left) > 160 else left
                right = re.sub(r"[^ \t\n\r\f\v]+$", "", right[:160]) if len(right) > 160 else right
                entity = (no, m[0].lower() if no == 0 else m[0] if no == 1 else re.sub("[^0-9]", "", m[0]))
                out.append((m.start(), no, m.end(), entity, left, right))
    return out


def plain_spans(texts):
    import regex

    token, letters = r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.@-]*|[\p{L}\p{M}]+", r"[\p{L}\p{M}]+"
    n = Counter(w.lower() for t in texts for w in regex.findall(letters, t))
    near, found = Counter(), []
    for text in texts:
        base, words = plain_matches(text), set()
        for start, _, stop, entity, left, right in base:
            around = [[(m[0], origin + m.start(), origin + m.end()) for m in regex.finditer(token, side) if "@" not in m[0]] for side, origin in ((left, start - len(left)), (right, stop))]
            around = [x for x in around[0] if x[2] < start][-8:] + [x for x in around[1] if x[1] > stop][:8]
            words |= {(entity, w.lower(), a, z) for w, a, z in around}
        near.update((w, entity) for entity, w, _, _ in words)
        found.append((base, words))
    out = []
    for base, words in found:
        spans = {(a, no, z) for a, no, z, *_ in base}
        told = {}
        for entity, w, a, z in words:
            share = near[w, entity] / (max(n[w], near[w, entity]) + 2)
            if n[w] and share >= 1 / 3 - 1e-12:
                told[a, z] = max(told.get((a, z), 4), 5 if share >= 0.5 else 4)
        out.append(",".join(f"{('email', 'ip', 'card', 'phone', 'generalise', 'remove')[k]}:{a}:{z}" for a, k, z in sorted(spans | {(a, k, z) for (a, z), k in told.items()})))
    return out


def private_rows():
    r = np.random.RandomState(9)
    fill = lambda k: " ".join(f"{'ba be bi bo bu'.split()[r.randint(5)]}{'la le li'.split()[r.randint(3)]}" for _ in range(k))
    texts = [None, "", "   ", "plain words only " + fill(30), "write to Jane.Doe@mail.example.com today", "write to jane.doe@MAIL.example.com or to Zork", "Zork the great, jane.doe@mail.example.com, Zork again"]
    texts += ["ip 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5 and 00255.1.1.001 x", "a@b.cd_x@e.fg@h.ij me@host me@host.", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111  1111 1111 1111", "call +1 (743) 555-3824 now, +123 no, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 no"]
    texts += [fill(40) + " Quux Quux bob@x.org Quux " + fill(40)] * 3 + [f"{fill(12)} mail{i}@y.net {fill(12)} 192.168.{i}.1 {fill(3)}" for i in range(25)]
    texts += ["1" * 4000, "a" * 4000 + "@", "x" * 3000 + "@long.example.com " + fill(5), "9 " * 30_000, fill(20_000) + " end@of.it", "日本 tél +33 6 12 34 56 78 é̀ñ 😀 jürgen@example.com 😀 naïve", "+" * 3000 + "1 234 567 8901", "ΑΣ Σ info@α.example.com ΟΔΟΣ ας@x.yz"]
    return [(i, t, "en", None, 1, "t", "p", 0.1) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None, None, None, None), (4, "other text under id four me@host.de", "en", "s", 1, None, None, None), (None, "no id: me@host.de", "en", "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]


def test_personal_data_against_brute_force(spark):
    rows = private_rows()
    got = private.spans_of(spark.createDataFrame(rows, SHAPE).withColumnsRenamed({"term": "found", "part": "blob"}).repartition(3)).collect()
    want = plain_spans([t or "" for _, t, *_ in rows])
    expected = []
    for (i, *_), spans in zip(rows, want):
        base = [s for s in spans.split(",") if s and s.split(":")[0] in PLAIN]
        expected.append((i or 0, *[sum(s.startswith(k + ":") for s in base) for k in PLAIN], H(",".join(base)), spans))
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(expected)
    assert any("remove:" in s for s in want) and any("generalise:" in s for s in want) and want[3] == ""


def test_texts_are_sanitised(spark):
    rows = private_rows()
    clean = {r.doc_id: r.text for r in private.sanitised(spark.createDataFrame(rows, SHAPE).filter("doc_id <> 4")).collect()}
    assert clean[0] is None and clean[3] == rows[3][1] and clean[1] == ""
    assert "Quux" not in clean[11] and "[email]" in clean[11] and "@" not in clean[11]
    assert "255" not in clean[7][:20] and "10.0.0.256" in clean[7] and "[card]" in clean[9] and "[phone]" in clean[10] and "+123 no" in clean[10]


def test_disclosure_bits(spark):
    near = spark.createDataFrame([("b", "e", "rare", 0, 4, 6), ("b", "e", "once", 9, 13, 1), ("b", "e", "the", 20, 23, 6), ("c", "f", "half", 0, 4, 2)], "blob string, entity string, term string, start long, stop long, copies long")
    corpus = spark.createDataFrame([("rare", 6), ("once", 1), ("the", 1000), ("half", 4), ("other", 13)], "term string, n long")
    rows = {r.term: r for r in private.evidence(near, corpus).collect()}
    assert {t: r.kind for t, r in rows.items()} == {"rare": 5, "once": 4, "half": 4}
    assert all(abs(r.pmi + r.hidden - r.information) < 1e-9 for r in rows.values()) and abs(rows["rare"].information - np.log2(1024 / 13)) < 1e-9


def test_personal_data_of_nothing(none):
    assert private.spans_of(none).collect() == [] and private.sanitised(none).collect() == []


def test_long_runs_take_linear_time(spark):
    """The plain patterns try a run of one class at each of its starts; 2 million characters would take hours."""
    texts = ["1" * 2_000_000, "a" * 2_000_000 + "@b.cd", "1." * 1_000_000, "9 " * 1_000_000, "a" * 2_000_000 + "@", "a.b" * 600_000 + " x@y.zz"]
    rows = private.spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows} == {0: (0, 0, 0, 0), 1: (1, 0, 0, 0), 2: (0, 250_000, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (1, 0, 0, 0)}
