"""Operators on texts against brute force, on whole small tables and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ferryline.llm import difference_cover, near_copies, pieces, simhash, spotsigs, token_files
from ferryline.llm.components import components
from ferryline.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def given(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def empty(docs_of):
    return docs_of([(0, "x")]).limit(0)


# --- components and SimHash ----------------------------------------------------


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    random.Random(1).shuffle(links)
    found = dict(map(tuple, components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()))
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1100)} == {1000}
    assert {found[i] for i in range(2000, 2007)} == {2000} and len(found) == 201 + 100 + 7


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    """Least key reachable for each (key, value) whose values are at most `bits` apart."""
    distinct = sorted(set(v for _, v in values))
    root = {v: v for v in distinct}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, v in values:
        if k is not None:
            least[find(v)] = min(least.get(find(v), k), k)
    return sorted(((k, f"{v:016x}", least.get(find(v))) for k, v in values), key=str)


def test_simhash_query_equals_brute_force(spark, small_tables):
    marks = [(i, brute_fingerprint(t)) for i, t in given(spark, small_tables)]
    found = sorted((tuple(r) for r in QUERIES["op1_simhash"](spark, small_tables).collect()), key=str)
    assert found == brute_components(marks, 2)


def test_simhash_of_odd_rows(docs_of, odd_texts):
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs_of(odd_texts)).collect()), key=str)
    assert found == brute_components([(i, brute_fingerprint(t)) for i, t in odd_texts], 2)
    assert simhash.near_duplicates(empty(docs_of)).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_give_the_reachability_of_all_pairs(spark, monkeypatch, bits, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)  # crowded and sparse buckets must agree
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            values.add(v)
    signed = [(0, v - (1 << 64) if v >> 63 else v) for v in values]
    pairs = simhash.links(spark.createDataFrame(signed, "space int, fp long"), bits).select("a", "b")
    root = dict(map(tuple, components(pairs).collect()))
    groups = {}
    for _, v in signed:
        groups.setdefault(root.get(v, v), set()).add(v % (1 << 64))
    want = {}
    for k, _, least in brute_components([(v, v) for v in values], bits):
        want.setdefault(least, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_thresholds_add_up_and_follow_cost():
    values = np.array([0, 1, 2**40], np.int64)
    groups = [list(range(0, 21)), list(range(21, 42)), list(range(42, 64))]
    chosen = simhash.thresholds(values, groups, np.full(64, 0.5), 10_000_000, 2, {(0, 0): 9_000_000})
    assert (chosen.sum(axis=1) == 0).all() and (chosen >= -1).all()
    assert chosen[0, 0] == -1 and (chosen[1] == 0).all()  # the part whose value is common isn't probed


def test_near_copies_meet_and_others_do_not(docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5_000)]
    bases = [[rng.choice(words) for _ in range(200)] for _ in range(30)]
    rows = []
    for i, base in enumerate(bases):
        copy = list(base)
        copy[rng.randrange(200)] = "other"  # five of about 200 shingles
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    rows += [(100, ""), (101, None), (102, " "), (103, rows[0][1].upper()), (103, rows[0][1].upper()), (None, rows[0][1])]
    found = dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect()))
    assert sum(found[2 * i + 1] == 2 * i for i in range(30)) == 30
    assert all(found[2 * i] == 2 * i for i in range(30))
    assert found[100] == found[101] == found[102] == 100 and found[103] == 0 and None not in found


def shingle_sets(rows, width=5):
    words = [(i, (t or "").lower().split()) for i, t in rows]
    return {i: {tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} for i, w in words}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size, other", [(0, 0), (1, 1), (9, 1), (300, 40), (560, 62), (560, 300), (20_000, 2_222)])
def test_sketches_differ_in_no_more_bits_than_the_sets_in_hashes(size, other):
    hashes = np.unique(np.random.default_rng(size + other).integers(0, 2**63, size + 2 * other).astype(np.uint64))
    a, b = np.sort(hashes[: size + other]), np.sort(np.append(hashes[:size], hashes[size + other :]))
    bits = sum(bin(x ^ y).count("1") for x, y in zip(near_copies.sketch(a), near_copies.sketch(b)))
    alone = len(np.setxor1d(a, b))
    assert bits <= alone == 2 * other
    assert (alone <= near_copies.most_differing(len(a) + len(b), 0.8)) == (near_copies.jaccard(a, b) >= 0.8 or size + other == 0)
    assert size > 2_000 or other * 2 < 400 or bits > near_copies.most_differing(len(a) + len(b), 0.8)  # and does rule out


def test_near_copies_hold_only_documents_of_similarity_eight_tenths(spark, docs_of, small_tables):
    rows = [r for r in given(spark, small_tables) if r[0] is not None]
    sets = shingle_sets(rows)
    found = dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect()))
    assert sorted(found) == sorted(sets)
    for i in sets:
        like = [j for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.8]
        assert all(found[j] == found[i] for j in like if jaccard(sets[i], sets[j]) >= 0.95)
        mates = [j for j in sets if j != i and found[j] == found[i]]
        assert not mates or max(jaccard(sets[i], sets[j]) for j in mates) >= 0.8


def test_a_common_passage_neither_links_documents_nor_hides_copies_among_them(docs_of):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(160)]
    own = {i: [f"d{i}_{k}" for k in range(45)] for i in range(120)}  # two share the passage: similarity 0.6
    rows = [(i, " ".join(passage + own[i])) for i in range(120)]
    copies = {}
    for i in range(20, 30):  # and a copy of similarity 0.95
        words = passage + own[i]
        words[rng.randrange(165, 200)] = "other"
        copies[500 + i] = i
        rows.append((500 + i, " ".join(words)))
    found = dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect()))
    assert all(found[i] == i for i in range(120))
    assert {i: found[i] for i in copies} == copies


@pytest.mark.parametrize("shared", [156, 168, 180])
def test_copies_are_found_among_documents_that_share_most_of_their_shingles(docs_of, shared):
    rng = random.Random(shared)
    passage = [f"p{i}" for i in range(shared + 4)]
    rows, at = [], {}
    for i in range(300):
        rows.append((i, " ".join(passage + [f"d{i}_{k}" for k in range(205 - shared)])))
    for n, i in enumerate(rng.sample(range(300), 100)):  # and copies that end in other words: similarity 0.8 to 0.9
        at[1_000 + n], other = i, rng.randrange(11, 23)
        rows.append((1_000 + n, " ".join(rows[i][1].split()[:-other] + [f"c{i}_{k}" for k in range(other)])))
    sets = shingle_sets(rows)
    want = brute_groups(sets)
    assert all(0.8 <= jaccard(sets[i], sets[at[i]]) < 0.9 for i in at) and want == {i: at.get(i, i) for i in sets}
    assert dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect())) == want


def brute_groups(sets, least=0.8):
    ids, group = sorted(sets), {i: i for i in sets}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return group


def test_copies_of_a_text_that_are_not_alike_are_linked_through_it(docs_of):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(204)]
    rows = [(900, " ".join(base))]
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(4, 200, 8), 4):
            words[p] = f"e{i}_{p}"  # 20 of 200 shingles: 0.82 to the text, 0.7 to another copy
        rows.append((i, " ".join(words)))
    found = dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect()))
    assert set(found.values()) == {0} and brute_groups(shingle_sets(rows)) == found


def test_long_texts_are_linked_from_eight_tenths_exactly(docs_of):
    n, rows, want = 4_000, [], {}
    for i, other in enumerate((444, 445, 446, 450, 460, 470, 480, 490, 500, 520)):  # 444 of 4,000 shingles: 0.8002; 445: 0.7998
        base = [f"d{i}_{k}" for k in range(n + 4)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-other] + [f"c{i}_{k}" for k in range(other)]))]
    sets = shingle_sets(rows)
    want = {j: j - j % 2 if jaccard(sets[j - j % 2], sets[j - j % 2 + 1]) >= 0.8 else j for j in sets}
    assert [j for j in want if want[j] != j] == [1]
    assert dict(map(tuple, near_copies.near_copies(docs_of(rows)).collect())) == want


# --- substrings ------------------------------------------------------------------


def brute_substrings(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for p in range(len(ws) - 12):
                key = tuple(ws[p : p + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for p in range(len(ws) - 12):
            if i is not None and first[tuple(ws[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def substrings(docs):
    return sorted((tuple(r) for r in difference_cover.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def test_cover_has_every_difference():
    for d in range(difference_cover.PERIOD):
        assert any((a - b) % difference_cover.PERIOD == d for a in difference_cover.COVER for b in difference_cover.COVER)


@pytest.mark.parametrize("group_bytes", [400, 4 << 20])
def test_substrings_equal_brute_force(docs_of, odd_texts, monkeypatch, group_bytes):
    monkeypatch.setattr(difference_cover, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(difference_cover, "PART_BYTES", 3 * group_bytes)
    rng = random.Random(5)
    passage = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(n)) for n in (12, 13, 14, 30, 80)]
    rows = [(200 + i, " ".join(rng.choice([rng.choice(passage), f"f{rng.randrange(9)}\t\n"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows = [*odd_texts, *rows, rows[3], (rows[3][0], "a b c"), (900, "p" * 300 + " q" * 20), (901, "p" * 300 + " q" * 20)]
    assert substrings(docs_of(rows)) == brute_substrings(rows)


def test_substrings_of_a_whole_table_and_of_none(spark, small_tables, docs_of):
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_substrings(given(spark, small_tables))]
    assert sorted((tuple(r) for r in QUERIES["op7_substrings"](spark, small_tables).collect()), key=str) == sorted(want, key=str)
    assert difference_cover.remove_repeats(empty(docs_of), ("lang",)).columns == [
        "doc_id", "text", "lang", "n_words", "n_removed", "kept_text"]
    assert substrings(empty(docs_of)) == []


# --- sentence pieces --------------------------------------------------------------


def test_pieces_equal_the_library(spark, small_tables, odd_texts, docs_of):
    model = pieces.Pieces(PIECES)
    rng = random.Random(7)
    made = ["".join(rng.choice("ab c▁\n\t.é日🙂 the") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts = [t or "" for _, t in [*odd_texts, *given(spark, small_tables)]] + made + [" " * 700, "a" * 1_000 + " b", "the" * 300]
    want = model.library.encode(texts, add_bos=True, add_eos=True)
    got = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [model.decode(x) for x in got] == [model.library.decode(x) for x in want]
    assert model.encode(texts[:30]) == got[:30] and model.encode([]) == []
    broken = np.array([1, 3 + 0xE3, 3 + 0x81, 300, 2], "<u4")
    assert model.decode(broken.tobytes()) == model.library.decode(broken.tolist())
    done = {r["doc_id"]: r for r in pieces.digests(docs_of(odd_texts), PIECES).collect()}
    assert done[1]["n_tokens"] == done[2]["n_tokens"] == 2 and len(done) == len({i for i, _ in odd_texts})
    assert done[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pieces.digests(empty(docs_of), PIECES).count() == 0


# --- token files -------------------------------------------------------------------


def test_word_tokens_equal_the_library(spark, small_tables, odd_texts):
    model = token_files.WordTokens(WORDS)
    assert model.short_cut
    rng = random.Random(9)
    made = ["".join(rng.choice("aB 'tsé.,!İΣß 12\n<|") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts = [t or "" for _, t in [*odd_texts, *given(spark, small_tables)]] + made
    want = [e.ids for e in model.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want


@pytest.mark.parametrize("part_bytes", [3_000, 48 << 20])
def test_token_files_round_trip(spark, docs_of, odd_texts, monkeypatch, folder, part_bytes):
    monkeypatch.setattr(token_files, "PART_BYTES", part_bytes)
    rows = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    library = token_files.WordTokens(WORDS).library
    want, start, stream = [], 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, stream = start + len(ids), stream + ids
    manifest = token_files.write(docs_of(odd_texts), folder, WORDS)
    found = [tuple(r) for r in token_files.read(manifest, folder).orderBy("start").collect()]
    assert found == want
    kept = []
    for r in manifest.orderBy("part").collect():
        reader, i, n = token_files.PartReader(folder, r["name"]), 0, 0
        while n < r["tokens"]:
            tokens, mask = reader.sequence(i)
            assert len(tokens) == len(mask) == token_files.LENGTH
            kept += tokens[mask].tolist()
            i, n = i + 1, n + int(mask.sum())
        with pytest.raises(IndexError):
            reader.sequence(i)
    assert kept == stream
    assert token_files.round_trip(spark, empty(docs_of), WORDS).count() == 0


def test_token_file_query_counts_up(spark, small_tables):
    rows = QUERIES["op10_token_files"](spark, small_tables).orderBy("doc_id").collect()
    ends = np.cumsum([r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == [0, *ends[:-1].tolist()] and len(rows) == len(given(spark, small_tables))


# --- SpotSigs -----------------------------------------------------------------------


def test_spotsigs_query(spark, small_tables):
    rows = sorted(given(spark, small_tables), key=lambda r: -r[0])
    found = {r["doc_id"]: r for r in QUERIES["op5_spotsigs"](spark, small_tables).collect()}
    marks = {}
    for k, (i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(re.findall("........", x)) for x in (
            found[i]["fingerprint"], found[i]["edited_fingerprint"], found[after[0]]["fingerprint"]))
        assert found[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b))
        assert found[i]["near_next"] == pytest.approx(len(a & c) / len(a | c))
        assert marks.setdefault(text, found[i]["fingerprint"]) == found[i]["fingerprint"]


def test_signatures_are_anchors_with_content_words(spark):
    texts = ["The cat sat on the mat!", "the CAT, sat. on the mat", "cat sat mat", "", "of the", "on the mat quickly jumped off roof"]
    df = spotsigs.with_signatures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s")
    found = [tuple(r) for r in df.select("text", "s").collect()]
    by = dict(found)
    assert by[texts[0]] == by[texts[1]] and len(by[texts[0]]) == 2  # the + cat sat mat, on the + mat
    assert len(by["cat sat mat"]) == len(by[""]) == 1 and by[""] != by["cat sat mat"]
    assert len(by[texts[5]]) == 1


def test_spotsigs_of_odd_rows(docs_of, odd_texts):
    found = spotsigs.compare_edited(docs_of(odd_texts)).collect()
    assert len(found) == len(odd_texts) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    one = spotsigs.compare_edited(docs_of([(7, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    assert spotsigs.compare_edited(empty(docs_of)).count() == 0


def test_next_rows_over_many_ranges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 10)
    ids = random.Random(2).sample(range(10**12), 150)
    df = docs_of([(i, f"t{i}") for i in ids]).select("doc_id", "text")
    found = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_spotsigs_near_duplicates(docs_of):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(3_000)]
    base = [" ".join(rng.choice(["the", "of", rng.choice(words)]) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " extra") for i, t in enumerate(base)] + [(200, base[0]), (201, None), (202, "")]
    found = dict(map(tuple, spotsigs.near_duplicates(docs_of(rows)).collect()))
    assert all(found[100 + i] == found[i] == i for i in range(12)) and found[200] == 0 and found[201] == found[202] == 201
    assert spotsigs.near_duplicates(empty(docs_of)).count() == 0


def test_queries_return_one_row_per_document(spark, small_tables):
    n = len(given(spark, small_tables))
    for name in ("op3_cotraining", "op6_pieces", "op8_sharding"):
        df = QUERIES[name](spark, small_tables)
        assert df.agg(F.count("*"), F.count_distinct("doc_id")).first() == (n, n)


def test_words_of_known_pieces_are_merged_without_a_call_each(monkeypatch):
    model, calls = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), []
    slow = pieces.Pieces._ids
    monkeypatch.setattr(pieces.Pieces, "_ids", lambda self, word, sym: calls.append(word) or slow(self, word, sym))
    texts = ["plain words and more of them " + " ".join(f"q{i}z" for i in range(300)), "a \U0001f9ff b", "", None]
    for text, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == [model.bos, *model.library.encode(text or ""), model.eos]
    assert calls == ["▁\U0001f9ff"]
