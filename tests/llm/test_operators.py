import collections
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from brindle.llm import bpe, chunks, langid, lines, matroska, mixing, ngramjoin, pii, queries, spotsigs, suffixes
from brindle.llm.common import Scratch, components

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, a long text, clashing extra columns."""
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "The cat sat on the mat. " * 60, "en", "a"), (4, "The cat sat on the mat. " * 60, None, "a"), (5, "one line\none  LINE\n\nother", "fr", "b"), (5, "one line\none  LINE\n\nother", "fr", "b"), (None, "no id here é", "en", "b"), (7, "x" * 200_000, "en", "a"), (8, "...\n---", "en", "b")]
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id bigint, text string, lang string, source string, key int, id string, pos int")


ALL = {
    "lines": lines.dedup, "pii": pii.detect, "chunks": chunks.dedup, "suffixes": suffixes.dedup, "media": matroska.media_column, "join": ngramjoin.join, "mix": mixing.mix, "spots": spotsigs.edited_likeness,
    "langid": lambda d: langid.predict(d, langid.fit(d, ~langid.held_out())), "bpe": lambda d: bpe.bpe_encode(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_and_empty_tables(name, odd):
    assert ALL[name](odd).count() == odd.count()
    assert ALL[name](odd.where("false")).count() == 0


def test_odd_stages(odd):
    for stage in (langid.reject, lines.drop_lines, ngramjoin.keep_one, mixing.reorder):
        out = stage(odd)
        assert out.columns == odd.columns
        out.collect()
    assert mixing.reorder(odd).count() == odd.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 100), (300, 300)]
    got = {r.node: r.root for r in components(Scratch(spark), spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 200: 100}


def removed_lines(rows, numbers=False):
    """How many lines are gone (or which) by document, by comparing all lines that share a shingle in one of their kinds."""
    places = [(d, i, lines.normal(x)) for d, t in sorted(rows) for i, x in enumerate((t or "").split("\n")) if lines.normal(x)]
    names = list(dict.fromkeys(x for _, _, x in places))
    parent = list(range(len(names)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k in (lines.FEW[0], lines.MANY[0]):
        sets = {i: frozenset(lines.shingles(x, k).tolist()) for i, x in enumerate(names) if k in lines.kinds(x.split())}
        where = collections.defaultdict(list)
        for i, s in sets.items():
            for j, n in collections.Counter(j for x in s for j in where[x]).items():
                if n * 10 >= 8 * (len(s) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
            for x in s:
                where[x].append(i)
    seen, gone = set(), {d: set() for d, _ in rows}
    index = {x: i for i, x in enumerate(names)}
    for d, i, x in places:
        if (r := find(index[x])) in seen:
            gone[d].add(i)
        seen.add(r)
    return gone if numbers else {d: len(x) for d, x in gone.items()}


@pytest.mark.parametrize("most", [lines.BROADCAST, 0])
def test_line_dedup_is_brute_force(docs, most, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST", most)
    got = {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()}
    assert got == removed_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_line_kinds():
    words = [f"word{i:02d}" for i in range(40)]
    assert lines.kinds(words[:5]) == (4,) and lines.kinds(words[:26]) == (4, 8) and lines.kinds(words) == (8,)
    assert lines.kinds(["ab", "cd"] * 5000) == lines.kinds(["=" * 9000]) == (4,)  # little is said, however long


def test_templated_lines_are_brute_force(spark, monkeypatch):
    from brindle.llm import pairs

    # buckets large enough for pivots, blocks small enough for several cells; families near the threshold, so that not all are like their pivot
    monkeypatch.setattr(pairs, "LARGE", 16)
    monkeypatch.setattr(pairs, "BLOCK", 8)
    rows = [(i, f"Page {i} of the annual footer report, volume {i % 7}, for the reader of it and all others") for i in range(150)]
    rows += [(1000 + i, f"row {i * 31 % 100:02d}: all rights reserved by the owners of this very long notice of copyright") for i in range(100)]
    got = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = removed_lines(rows)
    assert sum(got[d] != want[d] for d in want) <= 2  # a band may miss a pair at the threshold itself
    assert 20 < sum(got[d] for d in got if d < 1000) and sum(got[d] for d in got if d >= 1000) == 99


def test_line_dedup_finds_short_lines_with_one_edit(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 8)))
    rows = []
    for i in range(120):
        n = 40 + i % 61
        x = ""
        while len(x) < n:
            x += word() + " "
        x = x[: n - 1] + "."
        at = random.randrange(1, n - 1)
        rows += [(i, x), (1000 + i, x[:at] + random.choice(["", "#", "#" + x[at]]) + x[at + 1 :])]
    long = [(5000 + i, " ".join(word() for _ in range(4000))) for i in range(6)]
    got = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows + long, "doc_id bigint, text string")).collect()}
    assert sum(got[1000 + i] for i in range(120)) >= 117
    assert not any(got[i] for i in range(120)) and not any(got[i] for i, _ in long)


def test_shared_keys_are_brute_force():
    random.seed(7)
    some = [random.randrange(-(2**63), 2**63) for _ in range(800)]
    pairs = [(random.choice(some), random.randrange(50)) for _ in range(1000)] + [(9, i) for i in range(5000)] + [(5000, 1)] * 3
    ids = collections.defaultdict(set)
    for key, item in pairs:
        ids[key].add(item)
    random.shuffle(pairs)
    with np.errstate(over="ignore"):
        keys, where = lines.packed([np.array([[k] for k, _ in pairs])], [np.array([i for _, i in pairs])], 7)
        parts = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in where.to_pylist()]
        got = [r for part in parts for r in zip(*[c.tolist() for c in lines.shared_keys(part)], strict=True)]
    assert len(keys) == len(parts) == 7
    assert sorted((k, i, m) for k, i, m, _ in got) == sorted((k, i, len(own)) for k, own in ids.items() if len(own) > 1 for i in own)
    pivots = {k: {p for key, _, _, p in got if key == k} for k, _, _, _ in got}
    assert all(len(p) == 1 and p <= ids[k] for k, p in pivots.items())
    with np.errstate(over="ignore"):
        assert all(len(c) == 0 for x in ([], [(1, 2), (1, 2), (3, 2)]) for c in lines.shared_keys(np.array(x, np.int64).reshape(-1, 2)))


def test_keys_of_lines_are_shuffled_once(spark):
    random.seed(8)
    rows = [(i, "\n".join(" ".join(str(random.randrange(10**6)) for _ in range(6)) for _ in range(100))) for i in range(100)]
    rows.append((100, rows[0][1].replace("\n", "0\n")))
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(20_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    before = written()
    assert {r.doc_id: r.n_removed for r in lines.dedup(docs).collect() if r.n_removed} == {100: 100}
    time.sleep(0.2)
    spark.range(1).count()  # figures are brought up to date as tasks end
    # 10,000 unlike lines of 18 keys, some with near copies: a key and a hash of the line take 16 bytes
    assert 18 * 16 * 5000 < (n := written() - before) < 18 * 16 * 10_000 * 1.7, n


def all_links(sets):
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * (n := len(sets[a] & sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - n):
                links[a].add(b)
                links[b].add(a)
    return links


def link_classes(sets):
    links, out = all_links(sets), {}
    for a in sorted(sets):
        todo = [a]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = a
                todo += links[x]
    return out


def test_join_is_brute_force(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.join(docs).collect()}
    sets = {r.doc_id: set(ngramjoin.shingles(r.text).tolist()) for r in docs.collect()}
    want, links = link_classes(sets), all_links(sets)
    assert got == {a: (want[a], len(links[a])) for a in sets}


def test_join_with_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, text), (1, text), (2, text + "more"), (None, "quite another text with words of its own"), (None, text), (5, "!!"), (5, "a b"), (5, "c d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngramjoin.join(docs).collect()), key=str)
    sets = {i: set(ngramjoin.shingles(t).tolist()) for i, (_, t) in enumerate(rows)}
    links = all_links(sets)
    assert sorted(x[2] for x in got) == sorted(len(links[i]) for i in sets)
    assert [x for x in got if x[0] == 5] == [(5, 5, 0, 0)] * 3
    kept = sorted(((r.doc_id, r.text) for r in ngramjoin.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, rows[3][1]), (None, text), (5, "!!"), (5, "a b"), (5, "c d")], key=str)


def test_join_runs_suffice_for_nested_sets():
    small, large = np.arange(1, 401, dtype=np.uint64), np.arange(1, 501, dtype=np.uint64)
    shared = ngramjoin.PICK * len(small) / len(large)  # of the large set's picks, those that lie in the small one
    p = 1.0
    for _ in range(ngramjoin.LEVELS + 20):
        p = 1 - np.exp(-shared * p)
    assert (1 - p) ** ngramjoin.runs_needed() <= ngramjoin.MISS


def test_dense_groups_and_cells(spark, monkeypatch):
    from brindle.llm import pairs

    monkeypatch.setattr(pairs, "BLOCK", 8)
    random.seed(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[random.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string"), small=10).collect()
    assert {r.class_id for r in got} == {0}
    assert sum(r.n_links for r in got) > 0.98 * sum(1 for a in rows for b in rows if a != b and 10 * len(set(ngramjoin.shingles(a[1])) & set(ngramjoin.shingles(b[1]))) >= 8 * len(set(ngramjoin.shingles(a[1])) | set(ngramjoin.shingles(b[1]))))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [4096, 2])
def test_suffix_dedup_is_brute_force(docs, keep, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "ORDER_BLOCKS", crowd)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs, keep=keep).collect()}
    texts, n = {r.doc_id: r.text.encode() for r in docs.collect()}, suffixes.LENGTH
    times, first = collections.Counter(), {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - n + 1):
            w = texts[d][i : i + n]
            times[w] += 1
            first.setdefault(w, (d, i))
    for d, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if times[w] > 1 and (keep == "none" or first[w] != (d, i)):
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[d] == (int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


def test_factor_arrays():
    random.seed(2)
    for k in range(60):
        x = [random.randint(1, 3) for _ in range(random.randint(1, 50))]
        depth = random.choice([8, 13, 31, 200])
        match = lambda i, j: next((n for n in range(depth) if max(i, j) + n >= len(x) or x[i + n] != x[j + n]), depth)  # noqa: E731, B023
        assert suffixes.previous_factors(np.array(x), depth).tolist() == [max([match(i, j) for j in range(i)], default=0) for i in range(len(x))]
        assert suffixes.other_factors(np.array(x), depth).tolist() == [max([match(i, j) for j in range(len(x)) if j != i], default=0) for i in range(len(x))]


def test_chunks_resist_shifts():
    random.seed(1)
    text = bytes(random.choice(b"abcdefgh ") for _ in range(5000))
    a, b = chunks.cuts(text), chunks.cuts(b"a few more bytes " + text)
    pieces = lambda t, ends: {t[s:e] for s, e in zip([0, *ends], ends, strict=False)}
    assert len(pieces(text, a) & pieces(b"a few more bytes " + text, b)) > 0.95 * len(a)
    assert b"".join(text[s:e] for s, e in zip([0, *a], a, strict=False)) == text


def test_chunk_dedup_finds_passages(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80)) + " " + (shared if i % 4 == 0 else "") + " " + " ".join(word() for _ in range(80))) for i in range(40)]
    got = {r.doc_id: r.n_removed for r in chunks.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all((got[i] > 100) == (i % 4 == 0 and i > 0) for i in got)


def test_language_id(docs):
    out = langid.predict(docs, langid.fit(docs, ~langid.held_out()), keep=("lang",)).where(langid.held_out())
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    junk = docs.sparkSession.createDataFrame([(1, "1234 !!"), (2, None), (3, "日本語のテキストです" * 5)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(junk, langid.fit(docs, ~langid.held_out())).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[3].rejected


def test_language_id_keeps_short_clean_documents(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ~langid.held_out())
    assert [t for t in ("This.", "Avec.", "Edrere.", "A.", "A.\nAll rights reserved.") if model.predict(t)[2]] == []
    assert all(model.predict(t)[2] for t in ("日本語のテキストです" * 5, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 3))


def test_private_data_is_the_patterns():
    cues = pii.automaton()
    random.seed(3)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda t: re.sub("[^0-9]", "", t)
    good = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 16 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 8 <= len(digits(t)) <= 15}
    for k in range(8000):
        t = "".join(random.choice("a@.+-1 234()é\n" if k % 2 else "12.+-4@a") for _ in range(random.randint(0, 60)))
        if k % 5 == 0:
            t = "4111 1111 1111 1111" + t + "4111-1111-1111-1111" + t[:3] + "4111111111111111"
        found = pii.find(t, cues)
        assert {n: found[n] for n in patterns} == {n: [m.span() for m in re.finditer(p, t) if good[n](m[0])] for n, p in patterns.items()}, t
    more = pii.find("see https://a.example/x?q=1. IBAN: DE89 3704 0044 0532 0130 00", cues)
    assert more["url"] == [(4, 27)] and len(more["account"]) == 1


def test_documents_that_share_an_id_lose_only_their_own(spark):
    random.seed(9)
    text = lambda: " ".join("".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(90))
    one, two, three = text(), text(), text()
    rows = [(None, f"{one}\n{two}"), (None, f"{three}\n{one}"), (4, f"{two}\n{three}"), (4, text()), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.text or "" for r in lines.dedup(docs).collect()]
    assert sum(t.count(x) for t in kept for x in (one, two, three)) == 3 and any(rows[3][1] == t for t in kept)
    assert sorted(r.n_bytes - r.n_removed for r in suffixes.dedup(docs, keep="none").collect())[-1] == len(rows[3][1])
    left = {r.text for r in chunks.dedup(docs).collect()}
    assert rows[3][1] in left and sum(map(len, left)) < 4.3 * len(one)


def test_adversarial_addresses_are_linear():
    began = time.time()
    assert pii.find("http://-" * 130_000, pii.automaton())["url"] == []
    assert time.time() - began < 5


def test_private_data_query_is_the_patterns(docs):
    """The digest of the base spans of whole documents, from the four patterns themselves."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and pii.luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    ]
    got = {r.doc_id: r for r in queries.op4_pii(docs.sparkSession, DATA).collect()}
    for r in docs.collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, good in kinds for m in re.finditer(p, r.text or "") if good(m[0])]
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(own.spans.split(",")) | {""} and own.n_email == sum(s.startswith("email:") for s in spans)


def test_media_query_is_brute_force(docs):
    got = {r.doc_id: r for r in queries.op6_matroska(docs.sparkSession, DATA).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        own = got[r.doc_id]
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256, own.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert own.media_bytes > len(payload) and len(own.media_sha256) == 64


def test_language_query_learns_from_its_folds_only(spark, docs):
    out = queries.op2_language_id(spark, DATA)
    got = {r.doc_id: r for r in out.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in langid.predict(wrong, langid.fit(wrong, ~langid.held_out())).collect()}
    assert again == {d: r.lang_pred for d, r in got.items()}


def test_training_sample_is_bounded(spark):
    same = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text ', id) AS text", "if(id % 3 = 0, 'xx', 'yy') AS lang")
    one = spark.range(3000).selectExpr("1L AS doc_id", "'the same text' AS text", "concat('l', id % 90) AS lang")
    for docs, want in ((same, 60), (one, 60)):
        assert langid.training_rows(docs, F.lit(True), "doc_id", "text", "lang", 60).count() == want


def test_matroska_round_trips():
    random.seed(1)
    for n in (0, 1, 575, 576, 577, 5000, 200_000):
        data = matroska.pad(random.randbytes(n))
        assert len(data) % 576 == 0 and len(data)
        for lacing in ("auto", "none", "xiph", "ebml", "fixed"):
            file = matroska.write(data, lacing=lacing, laced=1 if lacing == "none" else 8)
            got = matroska.read(file)
            assert matroska.payload_of(file, got) == data and len(got["cues"]) == got["clusters"]
    sizes = [3, 900, 1, 255, 510]
    body = matroska.laced_block(1, 0, [bytes(s) for s in sizes], "ebml")
    assert [e - s for s, e in matroska.unlace(body, 0, len(body))[3]] == sizes
    with pytest.raises(ValueError):
        matroska.read(b"not a file")


def test_bpe_is_tiktoken(docs):
    e = bpe.PrefixBPE(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    random.seed(1)
    for k in range(2000):
        t = "".join(random.choice("aeé ñ\n \t9.😀漢don'treation") for _ in range(random.randint(0, 60)))
        ids = real.encode_ordinary(t)
        assert e.encode(t) == ids == np.frombuffer(b"".join([x[1] for x in e.by_pieces(t)]), np.int32).tolist() and e.decode(ids) == t.encode()
        piece = t.encode()
        table = e.extend(piece, [])
        longer, more = e.append(piece, table, b" and")
        assert more == e.extend(longer, [])
        if piece:
            at = random.randrange(len(piece))
            new, edited = e.edit(piece, table, at, 1, b"xy")
            assert edited == e.extend(new, [])
    for r, x in zip(docs.orderBy("doc_id").collect(), bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect(), strict=True):
        ids = real.encode_ordinary(r.text)
        assert x.ids == ids and x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def chains_of(text):
    """The set of hashed chains, word by word."""
    if not text:
        return set()
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    content = [(w, i > 0 and words[i - 1] in spotsigs.WORDS) for i, w in enumerate(words) if w not in spotsigs.WORDS]
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFFFF
    out = {h(f"{a} {b} ") for (a, start), (b, _) in zip(content, content[1:], strict=False) if start}
    return out or {h(text)}


def printed(s):
    return f"{len(s)}:" + "".join(f"{x:08x}" for x in sorted(s))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_is_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in spotsigs.edited_likeness(docs).collect()}
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + nxt.text[:half]
        a, b, c = chains_of(r.text), chains_of(edited), chains_of(nxt.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), like(a, b), like(a, c))
    prints = {r.doc_id: chains_of(r.text) for r in rows}
    pairs = {(r.a, r.b) for r in spotsigs.near_duplicates(docs).collect()}
    reps = {}
    for d in sorted(prints):
        reps.setdefault(printed(prints[d]), (d, prints[d]))
    own = sorted((d, s) for d, s in reps.values() if s)
    assert pairs == {(a, b) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :] if like(x, y) >= 0.8}


def test_spotsigs_of_odd_ids_and_long_runs(spark):
    began = time.time()
    long = spark.createDataFrame([("a", "the " * 250_000), ("b", "the cat " * 120_000), ("a", "of cats and dogs of men"), (None, "x"), (None, None), ("a", "of cats and dogs of men")], "doc_id string, text string")
    got = spotsigs.edited_likeness(long).collect()
    assert len(got) == 6 and time.time() - began < 60
    rows = [(r.doc_id, r.text or "") for r in long.collect()]
    assert sorted(r.fingerprint for r in got) == sorted(printed(chains_of(t)) for _, t in rows)
    same = spotsigs.edited_likeness(spark.range(500).selectExpr("7L AS doc_id", "concat('of cats ', id, ' and dogs') AS text"))
    assert same.count() == 500 and same.select("fingerprint").distinct().count() == 500


def test_mixing_keeps_to_unrounded_weights():
    # a source of a share far below a slot of 4,096, and weights that no short period holds
    weights = {"hot": 1 / 3, "rare": 0.00003, None: 0.017, **{f"s{i}": 0.031 + i * 1e-7 for i in range(20)}}
    sizes = {k: 40 + round(3_000_000 * w) for k, w in weights.items()}
    total = sum(map(Fraction, weights.values()))
    share = {k: Fraction(w) / total for k, w in weights.items()}
    done, slots, exact = collections.Counter(), set(), 0
    for k, i, slot, sure in mixing.places(sizes, weights, 16):
        assert i == done[k] and i // share[k] <= slot < -(-(i + 1) // share[k]) and slot not in slots
        done[k] += 1
        slots.add(slot)
        exact += sure
        if sure:
            assert slot + 1 == exact
            if slot % 97 == 0:
                assert all(abs(done[s] - x * exact) < 1 for s, x in share.items())
    assert exact > 20 * mixing.PERIOD and done == {k: -(-n // 16) for k, n in sizes.items()}


def test_mixing_rows_keep_to_unrounded_weights(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(F.lit(None)).alias("source"))
    weights = {"a": 0.5, "b": 0.3337, None: 0.1663}
    want = {(k, i): (slot, exact) for k, i, slot, exact in mixing.places({k: 2000 for k in weights}, weights, 4)}
    for most in (mixing.BROADCAST, 0):
        monkeypatch.setattr(mixing, "BROADCAST", most)
        rows = mixing.mix(docs, block=4, period=8, weights=weights).collect()
        assert len(rows) == 6000 and {(r.source, r.block): (r.slot, r.exact) for r in rows} == want
    done, total = collections.Counter(), sum(weights.values())
    for t, k in enumerate((k for slot, k in sorted((s, k) for (k, _), (s, exact) in want.items() if exact)), 1):
        done[k] += 1
        assert all(abs(done[s] - w / total * t) < 1 for s, w in weights.items())


def test_mixing_of_many_sources(spark):
    many = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), F.col("id") % 5000).alias("source"))
    slots = [r.slot for r in mixing.mix(many).select("slot", "source").distinct().collect()]
    assert None not in slots and len(set(slots)) == len(slots) == 5000
    few = many.where("doc_id < 300")
    rows = mixing.mix(few, period=1, weights={f"site{i}": 1 + i for i in range(300)}).collect()
    assert len(rows) == 300 and all(r.slot is not None for r in rows)


def test_mixing_of_documents(docs):
    rows = mixing.mix(docs, block=2, period=100, weights={f"src{i}": i for i in range(20)}).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    slots = collections.defaultdict(set)
    for r in rows:
        if r.slot is not None:
            slots[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in slots.values()) and all(r.slot is None for r in rows if r.source == "src0")


def test_pipeline_is_brute_force(spark):
    """run() against a plain version: the fitted classifier text by text, all lines and all documents compared, exact shares, tiktoken."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    rows = {r.doc_id: r for r in docs.collect() if not model.predict(r.text)[2]}
    left = kept_texts({d: r.text for d, r in rows.items()})
    sets = {d: set(ngramjoin.shingles(t).tolist()) for d, t in left.items()}
    classes = link_classes(sets)
    stay = {d: left[d] for d in left if classes[d] == d}
    out = corpus_pipeline.run(spark, DATA).orderBy("mix_part", "mix_row").collect()
    assert sorted(r.doc_id for r in out) == sorted(stay) and len(stay) > 100
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert all(r.ids == real.encode_ordinary(stay[r.doc_id]) and r.lang == (rows[r.doc_id].lang or model.predict(rows[r.doc_id].text)[0]) and r.source == rows[r.doc_id].source for r in out)
    # the order: sources' blocks by slot, and no block of a source before an earlier one
    mixed = mixing.mix(spark.createDataFrame([(d, rows[d].source) for d in stay], "doc_id bigint, source string")).collect()
    place = {r.doc_id: (r.slot, r.seq) for r in mixed}
    assert [place[r.doc_id] for r in out] == sorted(place.values())


def kept_texts(texts):
    """What line dedup leaves of each document, those without any line left out."""
    gone = removed_lines(list(texts.items()), numbers=True)
    out = {}
    for d, t in texts.items():
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        if not gone[d] or kept.strip():
            out[d] = kept
    return out


def test_registered():
    assert sum(re.match(r"op\d+_", k) is not None for k in queries.queries()) == 10 and "pipeline" in queries.queries()
