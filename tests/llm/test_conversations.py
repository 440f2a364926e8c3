"""The conversation trie, structure repair and packing against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import packing, prefix_trie, structure_repair
from plinth.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
CONVS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(r, n):
    """Conversations that share beginnings, with nulls, repeated rows and ids, a long one, and ids far apart and below 0."""
    rows = []
    for c in [*range(n), 100, 101, 150, 203, -5, 70_000, 200_000]:
        for t in range(r.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["Hi.", "Yes!", "no", "Ça va?", "", " \n", None, "Hi."])))
    rows += [(7, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(20, 120)]
    rows += rows[:6] + [(3, None, "user", "first?"), (9, None, None, None)]
    r.shuffle(rows)
    return rows


# --- 11


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            d = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            convs.setdefault(c, []).append((t is not None, t or 0, d, (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(int(c - np.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = [x for x in below if not any(y[:-1] == x and len(y) == len(x) + 1 for y in members)]
        ends = sorted(c for c in who if len(made[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children, len(leaf), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = talk(random.Random(3), 40) + [(None, 0, "user", "nobody's")]
    df = spark.createDataFrame(rows, CONVS).repartition(3).withColumn("n1", F.lit(1)).withColumn("own", F.lit("x"))
    assert sorted(map(tuple, prefix_trie.trie_report(df).collect()), key=repr) == brute_trie(rows)


def test_trie_of_the_table_and_of_none(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, prefix_trie.trie_report(df).collect()), key=repr) == brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert prefix_trie.trie_report(df.limit(0)).collect() == []


def test_shards_in_pieces(monkeypatch):
    """One conversation longer than many shards, and short ones, in batches that cut them anywhere."""
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "BLOCK", 10)
    rows = []
    for c, n in ((1, 3), (2, 95), (3, 1), (4, 30), (5, 2)):
        rows += [(c, d, c * (d > 0), d, c * (d > 1), d - 1, int(d == n), 2 * d) for d in range(n, -1, -1)]
    for size in (1, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + size]], pa.int64()) for i in range(8)], names=prefix_trie.FIELDS) for a in range(0, len(rows), size)]
        got = {}
        for b in prefix_trie._shards(iter(batches)):
            for n1, n2, leaves, saved in zip(*(b.column(k).to_pylist() for k in ("n1", "n2", "leaves", "saved")), strict=True):
                have = got.get((n1, n2), (0, 0))
                got[n1, n2] = have[0] + leaves, have[1] + saved
        assert got[0, 0] == (5, sum(x[7] for x in rows))
        assert got[2, 90] == (1, sum(2 * d for d in range(90, 96)))


def test_slots():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**63), 2**63, 5000), r.integers(-(2**63), 2**63, 5000)
    a[:100], b[100:200] = a[0], b[100]
    table = prefix_trie.NodeTable(a, b)
    assert sorted(table.find(a, b)) == list(range(5000))
    assert set(table.find(b, a)) == {-1}


# --- 13


def brute_repair(rows):
    """All series of edits of least cost, by a search over whole strings."""
    said = lambda x: " " if x is None else x
    convs = {}
    for c, t, role, text in rows:
        if c is None:
            continue
        mine = convs.setdefault(c, [])
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, mine in convs.items():
        mine.sort()
        seen, faults, counts = set(), [], [0, 0, 0, 0]
        for _, _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            f = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(f)
            counts[f] += 1
        # from the last row to the first: the best series for what is left, by the roles so far
        best = {(len(mine), s): (0, "", ()) if s in ("", "a") else (99**9, "", ()) for s in ("", "s", "u", "a")}
        for i in range(len(mine), -1, -1):
            now = {}
            for s in ("", "s", "u", "a"):
                options = [best[i, s]] if i == len(mine) else []
                if i < len(mine):
                    role, text = mine[i][2:]
                    stay = 3 if faults[i] == 3 else 0
                    options.append((4 + best[i + 1, s][0], "D" + best[i + 1, s][1], best[i + 1, s][2]))
                    if faults[i] not in (1, 2):
                        for to in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                            cost, audit, left = best[i + 1, to]
                            if role[:1] == to:
                                options.append((stay + cost, "K" + audit, (f"{role}:{text}", *left)))
                            if to != "s":
                                options.append((stay + 3 + cost, "R" + audit, (f"{'user' if to == 'u' else 'assistant'}:{text}", *left)))
                now[s] = min(options)
            for _ in range(4):
                for s in ("", "s", "u", "a"):
                    to = "a" if s == "u" else "u"
                    cost, audit, left = now[to]
                    now[s] = min(now[s], (cost + 3, "I" + audit, ("user:" if to == "u" else "assistant:", *left)))
            best |= {(i, s): v for s, v in now.items()}
        cost, audit, left = best[0, ""]
        turns = {t for known, t, _, _ in mine if known}
        roles = [x[2][:1] for x in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts[1:], illegal, cost, audit, sha("\n".join(left))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair(spark, seed):
    rows = talk(random.Random(seed), 150) + [(None, 0, "user", "nobody's")]
    df = spark.createDataFrame(rows, CONVS).repartition(3).withColumn("key", F.lit(1)).withColumn("fault", F.lit("x"))
    assert sorted(map(tuple, structure_repair.repair_report(df).collect())) == brute_repair(rows)


def test_repair_of_the_table_and_of_none(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, structure_repair.repair_report(df).collect())) == brute_repair([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert structure_repair.repair_report(df.limit(0)).collect() == []


def test_repair_holds_what_is_unresolved():
    repair, out, held = structure_repair.Repair(), [], 0
    r = random.Random(5)
    for _ in range(20_000):
        out += repair.row(r.choice(["user", "assistant", "assistant", "system"]), "x", r.choice([0, 0, 0, 3, 1, 2]))
        nodes, todo = 0, [repair.root]
        while todo:
            node = todo.pop()
            nodes += 1
            todo += node.kids
        held = max(held, nodes)
    out += repair.end()[0]
    assert held < 100
    assert sum(x.edit != "I" for x in out) == 20_000
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in out if x.edit != "D"))


def test_long_ties():
    """Roles that no turn may have stay unresolved; their comparison doesn't grow with them."""
    repair = structure_repair.Repair()
    out = [x for k in range(50_001) for x in repair.row("x", str(k), 0)]
    edits, cost = repair.end()
    assert cost == 3 * 50_000 + 4
    assert "".join(x.edit for x in out + edits) == "D" + "R" * 50_000
    assert [x.role for x in (out + edits)[:3]] == [None, "user", "assistant"]


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (2, 0, "user", None)], CONVS)
    got = [tuple(x)[:5] for x in structure_repair.repaired(rows).orderBy("conv_id", "step").collect()]
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi?"), (1, 3, "D", None, None), (1, 4, "I", "assistant", ""), (1, 5, None, None, None), (2, 0, "D", None, None), (2, 1, None, None, None)]


# --- 12


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def texts(r):
    odd = ["", None, " \n\t", "İstanbul ΣΑΣ ςσ ß", "é a ́b", "don't we'll I'M 2024 ½³", "a<|endoftext|>b <|startoftext|>", "日本語 　x y\u0085z", "x" * 3000, "‍👩‍👩‍👧 !!!???", "\x00\x1f \x0b\x0c a\r\nb"]
    alphabet = "abcdeΣσéÉ'’.,!0123 \n\t日本́ "
    return odd + ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(150)]


def test_ids_are_the_librarys(tokenizer):
    r, all_texts = random.Random(2), texts(random.Random(2))
    with open(tokenizer_path("word_bpe_49k.json"), "rb") as f:
        encoder = packing.Encoder(f.read())
    import pyarrow as pa

    for size in (1, 50, 10**6):
        r.shuffle(all_texts)
        for lo, hi, data, offsets in packing.text_slices(pa.array(all_texts, pa.string()), size):
            ids, first = encoder.slice(data, offsets)
            for i in range(hi - lo):
                assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(all_texts[lo + i] or "", add_special_tokens=False).ids


def check_packing(rows, got, tokenizer, window):
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    seen, windows = {}, {}
    for p in got:
        seen.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    assert set(seen) == set(want)
    for d, pieces in seen.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    padding = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += 0 if at & at - 1 == 0 else window - at
    assert padding == 0
    assert sum(len(p) > 0 for p in windows.values()) <= sum(map(len, want.values())) // window + 12


@pytest.mark.parametrize(("parts", "together", "most"), [(1, 256, 64), (7, 2, 3), (60, 3, 1)])
def test_packing(spark, tokenizer, monkeypatch, parts, together, most):
    monkeypatch.setattr(packing, "TOGETHER", together)
    rows = [(i, t) for i, t in enumerate(texts(random.Random(parts)))] + [(1000, "word and more " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("ids", F.lit("x")).withColumn("rest", F.lit(3))
    got = packing.packed(df, tokenizer_path("word_bpe_49k.json"), F.crc32("ids"), window=256, most=most).withColumnRenamed("ids", "ids_crc32").collect()
    check_packing(rows, got, tokenizer, 256)


def test_packing_of_the_table_and_of_none(spark, tokenizer):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in df.collect()], packing.packing_report(df, tokenizer_path("word_bpe_49k.json")).collect(), tokenizer, packing.WINDOW)
    assert packing.packing_report(df.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, "nobody's")], "doc_id long, text string")
    got = packing.packed(twice, tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens, p.start) for p in got)[-2:] == [(1, 2, 0), (1, 2, 0)]
    assert sum(p.length for p in got if p.doc_id is None) == len(tokenizer.encode("nobody's", add_special_tokens=False).ids) + 1
