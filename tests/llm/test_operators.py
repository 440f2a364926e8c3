"""The training-data operators against brute force, the libraries they must agree with, and round trips."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plinth.llm import chat_format, decontaminate, jaccard_join, language_id, piece_counts, quality_ledger, registry, sentencepiece_bpe, substring_dedup, url_lists, warc_convert
from plinth.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SEED = random.Random(7)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    """Exact and near copies, shared passages, short, empty, null and long texts, a null id and a repeated row."""
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ünd", "日本"]
    say = lambda n: " ".join(SEED.choice(vocab) for _ in range(n))
    base, passage = say(120).split(" "), say(60)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, ""), (4, "one Two"), (5, "ONE two"), (6, " \n\t ")]
    for i in range(7, 30):
        words = list(base)
        for _ in range(SEED.randint(0, 5)):
            words[SEED.randrange(120)] = SEED.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(i, f"{say(30)} {passage} {say(i)}") for i in range(30, 45)]
    rows += [(45, say(4000)), (46, "a b " * 200), (47, "x\n" * 40), (48, "[a] # b [c] <d> " + say(20)), (None, " ".join(base)), (8, rows[8][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 4


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        if i is not None:
            sets.setdefault(i, []).append(frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b] if s & t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[0]), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "block", "partners"), [(3, 90, 64, 32), (3, 90, 2, 0), (5, 80, 3, 1)])
def test_jaccard_components(docs, rows, monkeypatch, k, percent, block, partners):
    for name, value in {"BLOCK": block, "SKETCHES": block, "PARTNERS": partners}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    want = brute_components(rows, k, percent)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


@pytest.mark.parametrize("partners", [0, 10**6])
def test_jaccard_several_texts(spark, monkeypatch, partners):
    """Chains, stars and rings of near copies, and doc_ids with several texts, in any order."""
    monkeypatch.setattr(jaccard_join, "SKETCHES", 4)
    monkeypatch.setattr(jaccard_join, "PARTNERS", partners)
    r = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(50)]
        for _ in range(12):
            words = list(words)
            words[r.randrange(50)] = f"n{r.randrange(10**6)}"
            rows.append((r.randrange(60), " ".join(words)))
    rows += [(100, "a b c d e f"), (100, "u v w x y z"), (101, "a b c d e f"), (102, "u v w x y z"), (103, "a b c d e f")]
    r.shuffle(rows)
    want = brute_components(rows, 3, 80)
    assert {want[i][1] for i in (100, 101, 102, 103)} == {100}
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(i, c) for i, (_, c) in want.items()}


def test_sketch_never_loses_a_link():
    import numpy as np

    r = random.Random(9)
    sets = []
    for _ in range(40):
        base = [r.getrandbits(64) for _ in range(r.choice([1, 3, 40, 700]))]
        for _ in range(4):
            sets.append(np.unique(np.array([x if r.random() > 0.03 else r.getrandbits(64) for x in base], np.uint64)))
    sketches = jaccard_join.sketches_of(sets)
    n = np.array([len(x) for x in sets])
    kept = linked = 0
    for percent in (80, 90):
        for i, a in enumerate(sets):
            may = jaccard_join.may_link(np.int64(len(a)), n, sketches[i], sketches, percent)
            for j, b in enumerate(sets):
                kept += may[j]
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    linked += 1
                    assert may[j]
    assert linked <= kept < 2 * linked


@pytest.mark.parametrize("times, block", [(2, 64), (9, 2)])
def test_near_copies_in_repeated_rows(spark, monkeypatch, times, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    say = lambda i, j: " ".join([f"d{i}w{k}" for k in range(60)] + [f"e{j}"])
    docs = spark.createDataFrame([(6 * i + j, say(i, j)) for i in range(8) for j in range(2 + i % 2 * 4)], "doc_id long, text string")
    more = docs.crossJoin(spark.range(times)).select("doc_id", "text")
    got = jaccard_join.jaccard_components(more, 3, 90).collect()
    assert len(got) == times * docs.count()
    assert [r for r in got if r.component_id != r.doc_id // 6 * 6] == []
    # the filter keeps one row of each group, whatever other columns there are
    named = more.withColumn("row_key", F.lit("x")).withColumn("_doc2", F.rand(1))
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(named, 3, 90).collect()) == [6 * i for i in range(8)]


def test_one_of_each(docs, rows, empty):
    want = brute_components(rows, 5, 80)
    got = jaccard_join.one_of_each(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter([i for i in want if want[i][1] == i] + [i for i, _ in rows if i is None])
    assert jaccard_join.one_of_each(empty).count() == 0


def test_divide_skip_finds_all():
    r = random.Random(3)
    import numpy as np

    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(1, 60))], dtype=np.uint64)) for _ in range(150)]
    lists = jaccard_join.Lists(sets)
    for percent in (50, 80, 90, 100):
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert sorted(lists.search(q, percent)) == want


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


# --- 9


def brute_dedup(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[a : a + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_substring_dedup(docs, rows, empty):
    got = [tuple(r) for r in substring_dedup.dedup_report(docs).collect()]
    assert Counter(got) == Counter(brute_dedup(rows))
    assert any(r[2] for r in got)
    assert substring_dedup.dedup_report(empty).count() == 0
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, sha(" ".join(WORD.findall(r.text or "")))) for r in kept.collect()) == Counter((i, h) for i, _, _, h in brute_dedup(rows))


def test_substring_dedup_random(spark):
    r = random.Random(11)
    parts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(5, 30))) for _ in range(8)]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randint(1, 9)))) for i in range(60)]
    got = substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_dedup(rows))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


def test_regular_words_are_told_apart(spark):
    """A word and its complement, which a polynomial modulo a power of two can't tell apart."""
    a = thue_morse(4096)
    b = a.translate({97: 98, 98: 97})
    say = lambda w: " ".join(f"w{i}" for i in range(20)) + f" {w} " + " ".join(f"v{i}" for i in range(29))
    rows = [(1, say(a)), (2, say(b)), (3, say(a)), (4, f"{say(b)}\t"), (5, " ".join(a[:2048])), (6, " ".join(b[:2048]))]
    got = substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_dedup(rows))
    assert {r.doc_id: r.n_removed for r in got}[2] == 0
    found = jaccard_join.jaccard_components(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string"), 3, 90).collect()
    assert [r.component_id for r in sorted(found)] == [1, 2, 3, 4]


def test_ranges_are_verified_against_their_source():
    """A range goes only if its words have the digest of its source."""
    say = lambda x: " ".join(["m"] * 30 + [f"{x}{i}" for i in range(60)])
    spans = [{"start": 0, "end": 1, "da": 1, "db": 2}]
    assert substring_dedup.cut(say("a"), spans, 50) == say("a")
    da, db = substring_dedup._digest(" ".join(say("a").split()[:50]).encode())
    assert substring_dedup.cut(say("a"), [spans[0] | {"da": da, "db": db}], 50).split() == say("a").split()[50:]


# --- 7


def test_contamination(spark, docs, rows, empty):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = [(0, rows[0][1][:200]), (1, "one two"), (2, None), (3, "!!"), (4, rows[30][1]), (5, rows[0][1][:200]), (6, "Zwei eins")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = {}
    for i, t in items:
        w = norm(t)
        for a in range(max(1, len(w) - 12)):
            if w:
                table.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    want = Counter()
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(x) for x in table}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in table:
                    hit.update(range(a, a + n))
                    found |= table[x]
        want[(i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())) == want
    # several automata give the same
    parts = decontaminate.contamination(docs, bench, max_chars=150)
    assert Counter((r.doc_id, r.n_words, r.n_hit, sha(",".join(r["items"]))) for r in parts.collect()) == Counter({(a, b, c, e): n for (a, b, c, _, e, _), n in want.items()})
    left = Counter(x[0] for x, n in want.items() if not x[5] for _ in range(n))
    assert Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == left
    assert Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, max_chars=150).collect()) == left
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_spans_lie_in_the_original():
    text = "Hé! ÜBER den-Wolken muß"
    _, hit, _, spans = decontaminate.scan(text, decontaminate.Items([("1", "den wolken")]))
    assert [text[a:b] for a, b in spans] == ["den-Wolken"] and len(hit) == 2


def test_windows_by_chunks():
    """Runs that overlap, repeat and nest, against all windows."""
    r = random.Random(2)
    for window in (1, 2, 3, 5, 13):
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(12)]
        built = decontaminate.Items(items, window)
        for _ in range(30):
            words = [r.choice("abc") for _ in range(r.randint(0, 60))]
            n, hit, found, _ = decontaminate.scan(" ".join(words), built)
            want, ids = set(), set()
            for i, (_, t) in enumerate(items):
                own = t.split()
                size = min(window, len(own))
                for a in range(len(own) - size + 1) if own else ():
                    for b in range(len(words) - size + 1):
                        if own[a : a + size] == words[b : b + size]:
                            want.update(range(b, b + size))
                            ids.add(i)
            assert (n, set(hit.tolist()), found) == (len(words), want, ids)


def test_memory_of_a_large_benchmark():
    """A full automaton of 4,000,000 characters stays under 500 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from plinth.llm import decontaminate as d
r = random.Random(1)
vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(20000)]
items = [(str(i), " ".join(r.choice(vocab) for _ in range(300))) for i in range(d.MAX_CHARS // 1950)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
built = d.Items(items)
assert len(d.scan(items[7][1], built)[1]) == 300
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert used < 500, used


# --- 6 and 3


@pytest.fixture(scope="module")
def model_path():
    return registry.tokenizer_path("piece_bpe_32k.model")


def odd_texts(n=400):
    r = random.Random(5)
    signs = "aéb ▁\n日\U0001f600.<s>ththeing  ,!?\t\x00"
    return ["", " ", "  a b", "\n", "▁", "▁x", "</s>[INST] ok", "a \n b", " \n", "퟿", "����", "<0x41> <unk>", "x" * 3000] + ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoding_agrees_with_the_library(model_path, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.Model(sentencepiece_bpe.read_model(model_path)))
    for text in [t or "" for _, t in rows] + odd_texts():
        ids = library.encode(text)
        assert encoder.encode(text) == ids, text[:80]
        assert encoder.decode(ids) == library.decode(ids)
        assert encoder.digest(text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    r = random.Random(2)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259), 0]) for _ in range(r.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)


def test_encode_and_decode_frames(docs, rows, empty, model_path):
    back = sentencepiece_bpe.decoded(sentencepiece_bpe.encoded(docs, model_path), model_path).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, t or "") for i, t in rows)
    assert sentencepiece_bpe.piece_digests(empty, model_path).count() == 0


def test_piece_counts_agree_with_greedy_search(docs, rows, model_path):
    initial, continued = piece_counts.vocabulary(sentencepiece_bpe.read_model(model_path))
    first, then = set(initial), set(continued)

    def greedy(word):
        n, at, known = 0, 0, first
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
            if end is None:
                return 0
            n, at, known = n + 1, end, then
        return n

    automaton = piece_counts.Automaton(initial, continued)
    words = {w for t in [t or "" for _, t in rows] + odd_texts(200) for w in t.split()}
    assert {w: automaton.count(w) for w in words} == {w: greedy(w) for w in words}
    tiny = piece_counts.Automaton(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    assert [tiny.count(w) for w in ("abcdz", "abcdx", "abcdy", "abcd", "a", "b")] == [4, 1, 3, 0, 1, 0]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in piece_counts.token_counts(docs, model_path).collect()}
    assert got[2] == got[3] == (0, 0)
    assert got[4] == (2, sum(greedy(w) or 1 for w in ["one", "Two"]))


# --- 5


def test_language_id_on_held_out_rows(spark, empty):
    say = {"en": ["the", "and", "this", "with", "house"], "de": ["der", "und", "nicht", "straße", "haus"], "fr": ["les", "été", "avec", "maison", "être"]}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(say[x]) for _ in range(r.randint(3, 40))), x, f"{x}.example.com" if i % 2 else None, 0) for i, x in ((i, r.choice(list(say))) for i in range(300))]
    rows += [(900, "12345 --- 678", "en", None, 0), (901, None, None, None, 0), (902, "", None, "de.example.com", 0)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df.where("doc_id % 2 = 0 or doc_id >= 900"))
    got = {x.doc_id: x for x in language_id.identified(df, model, host="source").collect()}
    held = [x for x in rows if x[0] % 2 and x[0] < 900]
    assert sum(got[x[0]].language == x[2] for x in held) >= 0.98 * len(held)
    assert [got[i].kept for i in (900, 901, 902)] == [False] * 3
    assert {x.doc_id for x in language_id.keep_identified(df).collect()} == {x[0] for x in rows if x[0] < 900}
    assert language_id.language_report(empty).count() == 0


def test_language_evidence_of_pages(spark):
    say = {"en": "the and this with house ", "de": "der und nicht strasse haus "}
    train = spark.createDataFrame([(i, say[x] * 5, x) for i, x in enumerate(["en", "de"] * 10)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    pages = [(1, "http://a.example.de/x", "x q x"), (2, "http://a.example.com/de/x", "x q x"), (3, "http://a.example.com/x", '<html class=x lang="de">x q x</html>'), (4, "http://a.example.com/", "the with this and")]
    df = spark.createDataFrame(pages, "doc_id long, url string, text string")
    got = {r.doc_id: r.language for r in language_id.identified(df, model, url="url").collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["de", "de", "de", "en"]


def test_pages_in_any_markup(spark):
    """Scripts, styles and comments are no text; markup counts in any case; a user's name is no part of a host."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    german = "Die Verantwortung liegt in den Händen der ersten Einheiten und über die Entstehung der Arbeit wird berichtet"
    script = "<script>" + "the function of this thing is that the other one and then there\n" * 40 + "</script>"
    bodies = {
        1: f"<html><head>{script}</head><body>{german}</body></html>",
        2: f"<HTML LANG='de'><HEAD><STYLE>{'the other thing and then ' * 40}</STYLE></HEAD><!-- {'that there is the thing ' * 40} --><BODY><P>ab</P></BODY></HTML>",
        3: f"<!DOCTYPE html><body>{german}<script>{'and the other thing is there ' * 40}",
    }
    pages = spark.createDataFrame([(i, "http://the.user@host.example:80/x", t) for i, t in bodies.items()], "page_id long, url string, html string")
    got = {r.doc_id: r for r in language_id.identified(pages, model, url="url", text="html", key="page_id").collect()}
    plain = spark.createDataFrame([(1, f" {german} ")], "doc_id long, text string")
    assert got[1].n_grams == got[3].n_grams == language_id.identified(plain, model).first().n_grams
    assert {got[i].language for i in got} == {"de"}
    assert got[2].n_grams == 2


def test_host_priors_decide_what_a_text_leaves_open(spark):
    train = spark.createDataFrame([(i, t * 9, x) for i, (t, x) in enumerate([("the and this with ", "en"), ("der und nicht haus ", "de")] * 10)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    rows = [(i, "der und nicht haus " * 3, "a.one.org") for i in range(40)] + [(i, "the and this with " * 3, "b.two.org") for i in range(40, 80)] + [(100, "x q x", "a.one.org"), (101, "x q x", "b.two.org")]
    got = {r.doc_id: r.language for r in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, h string"), model, host="h").collect()}
    assert (got[100], got[101]) == ("de", "en")


def test_posterior_by_hand(spark):
    """Likelihood, markup, address and the priors without the document's own part, recomputed row by row."""
    import numpy as np

    r = random.Random(8)
    say = {"en": ["the", "and", "house"], "de": ["der", "und", "haus"], "fr": ["les", "avec", "maison"]}
    train = spark.createDataFrame([(i, " ".join(r.choice(say[x]) for _ in range(20)), x) for i, x in enumerate(list(say) * 15)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    hosts = [None, "a.de", "b.de", "x.a.org", "y.a.org"]
    rows = [(i, r.choice(hosts), r.choice(["", '<html lang="fr">', '<html lang="xx">']) + " ".join(r.choice(say[r.choice(list(say))]) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(60, "a.de", None), (61, "a.de", "123"), (5, hosts[3], "der und")]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, h string, text string"), model, host="h").collect()
    names, width = model.languages, 3
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    facts = []
    for i, h, t in rows:
        raw = np.frombuffer(re.sub("<[^>]*>", " ", t or "").encode(), np.uint8)
        _, bucket = language_id.trigrams(raw, np.array([0, len(raw)]))
        score = model.weights[bucket].sum(axis=0).astype(float) * max(1, len(bucket)) ** (language_id.TEMPER - 1)
        facts.append((i, h, t, len(bucket), score, soft(score) if len(bucket) else np.zeros(width)))
    domain = lambda h: ".".join(h.split(".")[-2:])
    want = Counter()
    for a, (i, h, t, n, score, _) in enumerate(facts):
        others = [f for b, f in enumerate(facts) if b != a]
        share = lambda keep, above, s: (sum((f[5] for f in others if keep(f)), np.zeros(width)) + s * above) / (sum(f[5].sum() for f in others if keep(f)) + s)
        prior = share(lambda f: True, np.full(width, 1 / width), width)
        if h:
            prior = share(lambda f: f[1] and domain(f[1]) == domain(h), prior, language_id.STRENGTH)  # noqa: B023
            prior = share(lambda f: f[1] == h, prior, language_id.STRENGTH)  # noqa: B023
        log = score + np.log(prior)
        for said, right in ((re.search('lang="(..)"', t or ""), language_id.MARKUP_RIGHT), (h and re.search(r"(de)$", h), language_id.ADDRESS_RIGHT)):
            if said and said[1] in names:
                log += [np.log(right) if x == said[1] else np.log((1 - right) / 2) for x in names]
        p = soft(log)
        want[(i, names[int(p.argmax())] if n else None, round(float(p.max()), 4) if n else 0.0, n, bool(n and p.max() >= language_id.LEAST))] += 1
    assert Counter((x.doc_id, x.language, round(x.confidence, 4), x.n_grams, x.kept) for x in got) == want


def test_rare_labels_are_learned(spark):
    df = spark.createDataFrame([(i, "the and this " * 3, "en") for i in range(3000)] + [(5000 + i, "und der nicht " * 3, "de") for i in range(2)], "doc_id long, text string, lang string")
    model = language_id.fit(df, sample=50)
    assert model.languages == ["de", "en"]
    assert {x.language for x in language_id.identified(df.where("lang = 'de'"), model).collect()} == {"de"}


# --- 1


def test_warc_round_trip(spark):
    body = "<p>größe</p>" * 20
    rows = [(1, "http://a/x y", body), (2, "http://b", body), (3, None, body), (4, "http://c", None), (5, "http://d", "tiny"), (6, "http://e", "tiny"), (7, "http://f", "WARC/1.0\r\n\r\nx\n" * 30), (None, "http://g", body), (0, "http://h", "other " * 40), (8, "http://i", "other " * 40)]
    got = {r.page_id: r for r in warc_convert.converted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        raw = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {2: 1, 3: 1, 8: 0}
    assert len({r.record_id for r in got.values()}) == len(rows) and got[1].url == "http://a/x%20y"
    assert warc_convert.converted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_lengths_are_what_counts():
    one = b"filedesc://x 0.0.0.0 20240101000000 text/plain 6\n1 0 X\n\n" + b"http://a 1.2.3.4 20240102030405 text/html 12\nab\nhttp://b \n\n"
    two = b"filedesc://x 0.0.0.0 20240101000000 text/plain 200 - - 0 f 6\n2 0 X\n\n" + b"http://a 1.2.3.4 20240102030405 text/html 200 - - 0 f 3\nabc\n"
    assert [r["block"] for r in warc_convert.arc_records(one)][1:] == [b"ab\nhttp://b "]
    assert [(r["status"], r["block"]) for r in warc_convert.arc_records(two)][1:] == [("200", b"abc")]
    skipped = []
    assert list(warc_convert.arc_records(two[:-3], skipped))[1:] == [] and skipped[0][1] == "shorter than it declares"


def test_archives_of_other_makers(spark, tmp_path):
    """No private header, blanks in an address, a name look-up, a broken line, a tail that is cut off."""
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"same words " * 20
    record = lambda url, date, kind, block: b"%s 1.2.3.4 %s %s %d\n%s\n" % (url, date, kind, len(block), block)
    about = b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    body = record(b"filedesc://old.arc", b"19990101000000", b"text/plain", about) + record(b"dns:a.org", b"19990101000000", b"text/dns", b"a.org A 1.2.3.4")
    body += record(b"http://a.org/x y", b"19990103000000", b"text/html", page) + b"what is this\nand this\n" + record(b"http://b.org/", b"19990102000000", b"text/html", page) + record(b"gopher://c.org/", b"19990102000000", b"text/plain", b"words")
    body += b"http://d.org/ 1.2.3.4 19990102000000 text/html 500\ncut"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(body)
    lost = warc_convert.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert [r.reason for r in lost.orderBy("place").collect()] == ["no ARC 1 header line", "shorter than it declares"]
    got = {r.url: r for r in warc_convert.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {u: r.record_type for u, r in got.items()} == {None: "warcinfo", "dns:a.org": "response", "http://a.org/x%20y": "revisit", "http://b.org/": "response", "gopher://c.org/": "resource"}
    assert got["http://a.org/x%20y"].payload_bytes == 220 and got["http://b.org/"].warc_date == "1999-01-02T00:00:00Z"


# --- 2, 8, 10


def arc(records, version=1):
    head = lambda r: f"{r[0]} 1.2.3.4 20010203040506 {r[1]} {'200 - - 0 f ' if version == 2 else ''}{r[2] if len(r) > 3 else len(r[2])}"
    about = f"{version} 0 x\n"
    return b"\n".join([f"filedesc://f 0 20010203040506 text/plain {'200 - - 0 f ' if version == 2 else ''}{len(about)}\n{about}".encode(), *(head(r).encode() + b"\n" + r[-1] for r in records)]) + b"\n"


def test_lost_headers_invent_no_records():
    page = b"HTTP/1.1 200 OK\r\n\r\nlook:\nGET a 20000101 b 5\nabcde\n\nhttp://x.org/ 1.2.3.4 20010203040506 text/html 3\nabcd"
    records = [("http://a.org/", "text/html", b"one"), ("http://b.org/", "text/html", "many", page), ("http://c.org/", "text/html; charset=utf-8", b"three"), ("http://d.org/a b", "x", b"four")]
    for version in (1, 2):
        skipped = []
        got = list(warc_convert.arc_records(arc(records, version), skipped))[1:]
        assert [(r["url"], r["type"], r["block"]) for r in got] == [("http://a.org/", "text/html", b"one"), ("http://c.org/", "text/html; charset=utf-8", b"three"), ("http://d.org/a%20b", "x", b"four")]
        assert len(skipped) == 1
        # the last record is found again too, and a header in a page that is read by its length is never looked at
        got = list(warc_convert.arc_records(arc([records[1], ("http://e.org/", "x", page)], version)))[1:]
        assert [(r["url"], r["block"]) for r in got] == [("http://e.org/", page)]


def test_keys_of_other_makers(spark, tmp_path):
    said = [b"abc", b"9" * 30, b"12", b"-"]
    blocks = [b"HTTP/1.1 200 OK\r\nX-Record-Key: " + k + b"\r\n\r\n" + b"p" * 200 for k in said]
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs" / "a.arc").write_bytes(arc([(f"http://{i}.org/", "text/html", b) for i, b in enumerate(blocks)]))
    assert warc_convert.convert(spark, f"file://{tmp_path}/arcs", f"file://{tmp_path}/warcs").collect() == []
    got = sorted((r.url, r.page_id, r.record_type, r.refers_to) for r in warc_convert.read_warc(spark, f"file://{tmp_path}/warcs").where("url is not null").collect())
    assert got == [("http://0.org/", None, "revisit", 12), ("http://1.org/", None, "revisit", 12), ("http://2.org/", 12, "response", None), ("http://3.org/", None, "response", None)]


def test_archives_end_by_size(spark, tmp_path):
    """A run of long pages makes short archives, whatever the mean is."""
    pages = spark.createDataFrame([(i, "http://a.org/", "x" * (5000 if i > 90 else 10)) for i in range(100)], "page_id long, url string, html string").coalesce(1)
    warc_convert.write_arc(pages, f"file://{tmp_path}/arcs", archive_bytes=8000)
    sizes = [len(warc_convert._plain(f.read_bytes())) for f in (tmp_path / "arcs").glob("*.gz")]
    assert len(sizes) > 5 and max(sizes) < 8000 + 5200
    warc_convert.convert(spark, f"file://{tmp_path}/arcs", f"file://{tmp_path}/warcs")
    assert sorted(r.page_id for r in warc_convert.read_warc(spark, f"file://{tmp_path}/warcs").where("record_type <> 'warcinfo'").collect()) == list(range(100))


def test_url_lists(spark):
    changes = [("block", "b.org", 3, True), ("block", "b.org", 9, False), ("allow", "a.b.org", 5, True), ("block", "c.org", 4, False), ("block", "x.b.org", 1, True), ("block", "x.b.org", 1, False), ("block", None, 1, True)]
    lists = url_lists.intervals(spark.createDataFrame(changes, "list string, entry string, day long, added boolean"))
    ask = [("http://b.org/", 2), ("http://b.org/", 3), ("https://u@B.org:80/x", 8), ("http://b.org", 9), ("http://a.b.org", 4), ("http://a.b.org", 6), ("http://c.org", 7), (None, 5), ("nonsense", 5), ("http://b.org", None), ("http://x.b.org", 2), ("http://b.org/", 3)]
    rows = [(i, u, d, 1) for i, (u, d) in enumerate(ask)]
    got = {r.id: r for r in url_lists.judged(spark.createDataFrame(rows, "id long, url string, fetched long, valid int"), lists).collect()}
    assert [got[i].blocked for i in range(len(ask))] == [False, True, True, False, True, False, False, False, False, False, True, True]
    assert got[5].n_active == 2 and got[5].entry == "a.b.org"


def test_chat_format(spark):
    rows = [(1, 0, "user", "a<|end|>~1["), (1, 1, "assistant", "<|turn|>b"), (2, 1, "assistant", None), (2, 0, "system", "s"), (3, 0, None, "x"), (4, 0, "user", ""), (4, 0, "user", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a<|end|>~1["), ("assistant", "<|turn|>b")]
    assert got[1].loss_text == "<|turn|>b" and got[1].valid and got[1].broken_at is None
    assert (got[2].valid, got[2].broken_at) == (False, 1)
    assert [(t.role, t.text) for t in got[3].turns] == [("", "x")]
    assert len(got[4].turns) == 2 and not got[4].valid and [(t.role, t.text) for t in got[None].turns] == [("user", "q")]
    assert chat_format.chat_report(df.limit(0)).count() == 1  # the probe


def test_a_long_chat(spark):
    """Work grows with the turns, not with their square."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<é"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = {r.conv_id: r for r in chat_format.chat_report(rows).collect()}
    assert time.time() - began < 60
    turns = [("user" if i % 2 == 0 else "assistant", f"<é{i}") for i in range(n)]
    assert got[1].n_turns == n and got[1].valid
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert got[1].loss_sha256 == sha("".join(t for r, t in turns if r == "assistant"))
    whole = chat_format.formatted(rows).first()
    assert all(whole.formatted[s.start : s.start + s.length] == f"~1é{i}" for i, s in enumerate(whole.segments))


def test_quality_ledger(docs, rows):
    def brute(text):
        t = text or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    got = quality_ledger.quality_report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    entries = quality_ledger.ledger(docs)
    only = {r.rule: r for r in quality_ledger.ablations(entries).collect()}
    failed = [r.failed for r in got]
    for name in quality_ledger.RULES:
        b = quality_ledger.bit(name)
        assert (only[name].n_failed, only[name].n_only) == (sum(bool(f & b) for f in failed), sum(f == b for f in failed))
    assert quality_ledger.keep(docs).columns == docs.columns


def test_clashing_columns(spark, docs, model_path):
    """Columns that have the names of an operator's own stay as they are, or are replaced where that is said."""
    names = ["spans", "row_key", "family", "rep", "keys", "n_words", "failed", "_doc", "_key", "host", "ids", "component_id", "language"]
    more = docs.where("doc_id < 6").select("*", *[F.lit("mine").alias(n) for n in names])
    bench = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    for kept in (substring_dedup.without_repeats(more), jaccard_join.one_of_each(more), decontaminate.drop_contaminated(more, bench), decontaminate.drop_contaminated(more, bench, max_chars=1), language_id.keep_identified(more), quality_ledger.keep(more)):
        assert kept.columns == more.columns
        assert all(r[n] == "mine" for r in kept.collect() for n in names)
    assert sentencepiece_bpe.encoded(more, model_path).where("size(ids) >= 0").count() == more.count()
    pages = spark.createDataFrame([(1, "http://a.org/", 3, "mine", "mine")], "id long, url string, fetched long, host string, entry string")
    lists = url_lists.intervals(spark.createDataFrame([("block", "a.org", 1, True)], "list string, entry string, day long, added boolean"))
    assert url_lists.judged(pages, lists).first().entry == "a.org"
    # Spark's names know no case: a column Host is one of that name, and no other is touched
    cased = url_lists.judged(pages.withColumnRenamed("host", "Host").withColumnRenamed("entry", "ENTRY").withColumn("Row", F.lit("mine")), lists)
    assert cased.columns == ["id", "url", "fetched", "Row", "host", "n_active", "entry", "blocked"]
    assert tuple(cased.first()) == (1, "http://a.org/", 3, "mine", "a.org", 1, "a.org", True)
    counted = quality_ledger.ledger(docs.where("doc_id = 4").withColumn("N_Words", F.lit("mine")).withColumn("_words", F.lit("mine"))).first()
    assert (counted.n_words, counted._words) == (2, "mine")
    odd = pages.select("id", "url", "fetched", *(F.lit("mine").alias(c) for c in ("_n", "_best", "n_active", "best", "list", "valid", "row")))
    assert url_lists.judged(odd, lists).columns == ["id", "url", "fetched", "_n", "_best", "best", "list", "valid", "row", "host", "n_active", "entry", "blocked"]
    assert url_lists.judged(odd, lists).select("best", "row", "blocked").first() == ("mine", "mine", True)
    own = more.select("doc_id", "text", *(F.lit("mine").alias(c) for c in ("_words", "_lines", "_at", "__h1", "_grams")))
    assert all(r["_words"] == r["__h1"] == r["_at"] == "mine" for r in quality_ledger.ledger(own).collect())


def test_hosts_and_addresses(spark):
    urls = ["http://[2001:DB8::1]:80/x", "http://10.1.2.3/x", "https://u:p@A.b.Org:1/", "mailto:x", None, "http://org/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", url_lists.host_of(F.col("url")).alias("h"))
    got = {r.i: (r.h, r.d) for r in df.select("i", "h", url_lists.domains_of(F.col("h")).alias("d")).collect()}
    assert got == {0: ("[2001:db8::1]", ["[2001:db8::1]"]), 1: ("10.1.2.3", ["10.1.2.3"]), 2: ("a.b.org", ["a.b.org", "b.org"]), 3: (None, [None]), 4: (None, [None]), 5: ("org", ["org"])}


def test_native_operators_on_empty_tables_and_odd_rows(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_lists.url_report(pages).count() == 0
    assert quality_ledger.quality_report(empty).count() == quality_ledger.ablation_report(empty).count() == 0
    turns = "conv_id long, turn long, role string, text string, valid string"
    assert chat_format.formatted(spark.createDataFrame([], turns)).count() == 0
    rows = [(None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x")]
    got = chat_format.read_back(chat_format.formatted(spark.createDataFrame(rows, turns))).collect()
    assert sorted((r.conv_id or 0, len(r.turns), r.valid) for r in got) == [(0, 1, False), (0, 1, False), (1, 3, False)]
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, f"{long} {long}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_repeat_words) for r in quality_ledger.quality_report(df).collect()) == [(1, 60_000, 0), (1, 60_000, 0), (2, 120_000, 120_000)]
