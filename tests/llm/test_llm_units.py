"""The operators' inner parts against brute force."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import components, grammar, licences, media, op2, op4, quality_rules, secrets_scan, sentencepiece_codec, simhash, token_files, toxicity
from glyphloom.llm.common import scratch_path


def groups_by_force(codes, radius):
    group = {c: {c} for c in codes}
    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
    return {frozenset(g) for g in group.values()}


def groups_of(codes, links):
    group = {c: {c} for c in codes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[b]:
                group[c] = group[a]
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("seed", range(6))
def test_tree_links(seed):
    rnd = random.Random(seed)
    codes = {rnd.getrandbits(64) for _ in range(40)}
    for c in list(codes)[:20]:
        for _ in range(6):
            c ^= 1 << rnd.randrange(64)
            codes.add(c ^ (1 << rnd.randrange(64)) if rnd.random() < 0.5 else c)
    codes = sorted(codes)
    rnd.shuffle(codes)
    assert groups_of(codes, simhash.local_links(codes)) == groups_by_force(codes, 3)
    tree = simhash.BKTree(codes)
    for q in codes[:10]:
        assert sorted(codes[k] for k in tree.within(q, 5)) == sorted(c for c in codes if (c ^ q).bit_count() <= 5)


def test_links_across_chunks(spark, monkeypatch):
    """A shard of more fingerprints than a tree may hold, cut by a third block and then into chunks, loses no link."""
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    codes = sorted({centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    fps = spark.createDataFrame([(c,) for c in signed], "fp long")
    for most in (4096, 60, 20, 3):
        monkeypatch.setattr(simhash, "SHARD_MOST", most)
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(fps).collect()]
        assert groups_of(codes, found) == groups_by_force(codes, 3)


def test_finer_keys(spark):
    """Codes within the radius that share a shard share one of its parts."""
    rnd = random.Random(2)
    rows = []
    for k in range(400):
        a = rnd.getrandbits(64)
        b = a
        for place in rnd.sample(range(64), rnd.randint(0, 3)):
            b ^= 1 << place
        rows.append((k, simhash.signed(a), simhash.signed(b)))
    pairs = spark.createDataFrame(rows, "k long, a long, b long").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(9))))
    key = lambda c: simhash.shard_keys(F.col(c))[F.col("p")]["v"]
    together = pairs.where(key("a") == key("b"))
    assert together.select("k").distinct().count() == 400
    finer = lambda c: simhash.finer_keys(F.col(c), F.col("p"))
    assert together.where(F.arrays_overlap(finer("a"), finer("b"))).count() == together.count()


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 330)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if x is not None}
    wanted = {min(g): g for g in groups_of(nodes, [e for e in edges if None not in e])}
    assert {frozenset(g) for g in wanted.values()} == {frozenset(k for k in nodes if found.get(k, k) == root) for root in wanted}


@pytest.mark.parametrize("seed", range(3))
def test_byte_level(seed):
    from tokenizers import Tokenizer

    rnd = random.Random(seed)
    t = Tokenizer.from_file(op2.tokenizer_path())
    own = token_files.ByteLevelEncoder(op2.tokenizer_path())
    texts = ["".join(rnd.choice("aé ñ.,;:!?'sS1²x_ \n\t\x1c\x85　-ª×ßŁ日😀") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["ab " * 60_000, "x" * 200_000, "don't, we'll.", "a\nb c.\nD, e"]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>x", "x<|endoftext|>", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n\n", "a<|endoftext", "<|<|endoftext|>|>", "x " * 50_000 + "<|endoftext|> y"]


def test_added_tokens():
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    texts = ADDED + ["".join(rnd.choice(["<|endoftext|>", "<|", "endoftext", "|>", " ", "a", "b.", "\n", "é"]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    for as_text in (False, True):
        t = Tokenizer.from_file(op2.tokenizer_path())
        t.encode_special_tokens = as_text
        own = token_files.ByteLevelEncoder(op2.tokenizer_path(), as_text)
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files_read_back(spark, monkeypatch):
    """Files of several parts, read as digests and as ids, one task for each part; and by ranges, as from a store without memory maps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op2.tokenizer_path())
    texts = [f"text {k} " * (k % 7) + ADDED[k % 8] for k in range(300)]
    docs = spark.createDataFrame([(7 * k % 300, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    out = scratch_path(spark, "tokens")
    monkeypatch.setattr(token_files, "READ_BYTES", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = token_files.write(docs, out, op2.tokenizer_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {r.doc_id: r for r in token_files.read_ids(index, out).collect()}
    start = 0
    for k, x in sorted((7 * k % 300, x) for k, x in enumerate(texts)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (found[k].start, found[k].ids) == (start, ids)
        start += len(ids)
    digests = token_files.read_digests(index, out)
    assert digests.rdd.getNumPartitions() == index.count() > 1 and digests.count() == 300
    name = index.first()["name"]
    p = token_files.Part(out, name)
    with open(f"{out.removeprefix('file://')}/{name}.bin", "rb") as f:
        ranges = token_files.Range(f, p.ids.dtype.str, len(p.ids))
        for a, b in [(0, 3), (5, 9), (2, 4), (len(p.ids) - 2, len(p.ids))]:
            assert (ranges[a:b] == p.ids[a:b]).all()


SP_TEXTS = ["", " ", "  ", "a  b", " a ", "▁", "a▁b", "▁▁x", "日本語 テキスト", "\x00", "<unk> <s> <0x41>", "x" * 400, "ﬁne Å ①  ｆｕｌｌ\u3000width", "a<own>b <own><own> <ownmore>"]


def sp_texts(seed=2):
    rnd = random.Random(seed)
    return SP_TEXTS + ["".join(rnd.choice([*" ▁ab\nc😀é日1.\t<>s", "the ", "<own>", "ing", "ﬁ", "e\u0301"]) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]


def test_sentencepiece_parity():
    path = op4.model_path()
    assert sentencepiece_codec.parity(path, sp_texts()) == []


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    """A protocol-buffer message of (number, value): bytes, whole numbers, or floats."""
    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(k << 3) + varint(v)
        else:
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def model_file(path, kind, byte_fallback, dummy, extra, charsmap=b"", own=()):
    """A model file of the public one's pieces; a unigram model's scores are drawn anew, so that there are no ties."""
    with open(op4.model_path(), "rb") as f:
        known = sentencepiece_codec.parse(f.read())
    rnd, pieces = random.Random(1), []
    used = set("".join(p for p, _, _ in known.pieces[:6000]))
    for piece, score, of in known.pieces[:6000] + [p for p in known.pieces[6000:] if p[0] in used]:
        if of == sentencepiece_codec.BYTE and not byte_fallback:
            continue
        if kind == sentencepiece_codec.UNIGRAM and of == sentencepiece_codec.NORMAL:
            score = -3.0 - 8.0 * rnd.random() - 0.3 * len(piece)
        pieces.append((piece, score, of))
    pieces += [(p, 0.0, sentencepiece_codec.USER_DEFINED) for p in own]
    body = b"".join(message((1, message((1, p.encode()), (2, float(x)), (3, of)))) for p, x, of in pieces)
    body += message((2, message((3, kind), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))))
    body += message((3, message((1, b"own"), *([(2, charsmap)] if charsmap else []), (3, int(dummy)), (4, int(extra)), (5, 1))))
    path.write_bytes(body)
    return str(path)


def nfkc():
    import sentencepiece

    found = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return next(v for n, x in sentencepiece_codec.fields(found) if n == 3 for n, v in sentencepiece_codec.fields(x) if n == 2)


@pytest.mark.parametrize("kind", [sentencepiece_codec.UNIGRAM, sentencepiece_codec.BPE])
@pytest.mark.parametrize("byte_fallback, dummy, extra, mapped, own", [(True, True, False, False, ()), (True, True, True, True, ()), (False, False, True, False, ()), (True, False, False, True, ("<own>", "<ownmore>"))])
def test_rebuilt_models(tmp_path, kind, byte_fallback, dummy, extra, mapped, own):
    """Unigram and BPE, with and without byte fallback, character map, dummy prefix and pieces defined by users; nothing is trained."""
    import sentencepiece

    path = model_file(tmp_path / "m.model", kind, byte_fallback, dummy, extra, nfkc() if mapped else b"", own)
    texts = sp_texts(3)
    differing = sentencepiece_codec.parity(path, texts)
    c, theirs = sentencepiece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert mapped or own or all(c.normalise(t) == c.marking.normalize_str(t) for t in texts)
    for k in differing:  # the same pieces in another order have the same score
        assert kind == sentencepiece_codec.UNIGRAM and sorted(c.encode([texts[k]])[0].tolist()) == sorted(theirs.encode(texts[k]))
    assert len(differing) < 0.01 * len(texts)


def test_container():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 9, 16, 17, 100):
        payload = rnd.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        stored = media.mux(payload)
        (track,) = media.tracks(stored)
        assert media.payload_of(stored, track) == payload
        f = media.feature(track)
        assert f["codec"] == "raw" and f["samples"] == n and f["keyframes"] == -(-n // media.KEYFRAME_EVERY)
        assert all(stored[a:b] == payload[192 * k * media.KEYFRAME_EVERY :][:192] for k, (a, b) in enumerate(f["ranges"]))
        kinds = [p[-1] for p, _, _ in media.walk(memoryview(stored))]
        assert {b"ftyp", b"moov", b"trak", b"stbl", b"mdat"} <= set(kinds)
        for cut in (5, 40, len(stored) // 2, len(stored) - 1):
            with pytest.raises(media.NotAContainer):
                media.tracks(stored[:cut])


def track_boxes(track, codec, table):
    """A track box with the given sample table."""
    box, full = media.box, media.full_box
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(20))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(20)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), *table)))
    return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, track, 0, 0), bytes(60)), mdia)


def test_fragments_and_compact_sizes():
    """Two tracks: one of fragments, with defaults, own sizes and flags, and one whose sizes are 4-bit numbers."""
    box, full = media.box, media.full_box
    none = [full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [full(b"stsz", struct.pack(">II", 0, 0))]
    body = bytes(range(60))
    head = box(b"ftyp", b"isom", bytes(4))

    def whole(at):
        small = [full(b"stts", struct.pack(">III", 1, 3, 5)), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stco", struct.pack(">II", 1, at + 50)), full(b"stz2", struct.pack(">II", 4, 3), bytes([0x12, 0x30]))]
        trex = full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0x10000))
        moov = box(b"moov", track_boxes(7, b"avc1", none), track_boxes(8, b"mp4a", small), box(b"mvex", trex))
        runs = full(b"trun", struct.pack(">IiI", 3, at, 0), flags=0x1 | 0x4) + full(b"trun", struct.pack(">I", 2) + struct.pack(">IIII", 5, 0x10000, 6, 0), flags=0x200 | 0x400)
        second = full(b"trun", struct.pack(">I", 1), flags=0)
        first = box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">IQ", 7, 0), flags=0x1), runs))
        return head + moov + first + box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQI", 7, at + 30, 9), flags=0x1 | 0x8), second)) + box(b"mdat", body)

    at = len(whole(0)) - len(body)
    data = whole(at)
    video, sound = media.tracks(data)
    assert (video["codec"], sound["codec"]) == ("avc1", "mp4a")
    assert video["sizes"].tolist() == [4, 4, 4, 5, 6, 4] and video["ticks"].tolist() == [10] * 5 + [9] and video["duration"] == 59
    assert (video["offsets"] - at).tolist() == [0, 4, 8, 12, 17, 30] and video["keys"].tolist() == [0, 4]
    assert media.payload_of(data, video) == body[:23] + body[30:34]
    assert sound["sizes"].tolist() == [1, 2, 3] and (sound["offsets"] - at).tolist() == [50, 51, 53] and sound["keys"].tolist() == [0, 1, 2]
    assert media.feature(video)["ranges"] == [[at, at + 4], [at + 17, at + 23]]
    with pytest.raises(media.NotAContainer):
        media.tracks(data[: -len(body)] + body[:20])


def test_suffix_automaton():
    """Matching statistics, and every place where an end of the matched passage ends, against all passages."""
    rnd = random.Random(3)
    sequences = [[rnd.randrange(4) for _ in range(rnd.randint(5, 20))] for _ in range(4)]
    automaton, places = licences.SuffixAutomaton(sequences), {}
    for k, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                places.setdefault(tuple(s[i:j]), set()).add((k, j))
    for _ in range(100):
        query = [rnd.randrange(5) for _ in range(30)]
        for i, (state, n) in enumerate(automaton.statistics(query)):
            assert n == max((m for m in range(1, i + 2) if tuple(query[i + 1 - m : i + 1]) in places), default=0)
            wanted = {}
            for m in range(2, n + 1):
                wanted |= {p: m for p in places[tuple(query[i + 1 - m : i + 1])]}
            found = list(automaton.endings(state, n, 2))
            assert {(k, j): m for k, j, m in found} == wanted and len(found) == len(wanted)


def best_chain(words, template, least, gap):
    """Brute force: the most words of the template that a chain of passages which cannot be extended covers."""
    matches = []
    for i in range(len(words)):
        for j in range(len(template)):
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= least and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                matches.append((i + n, j + n, n))
    best = {}
    for at, end, n in sorted(matches):
        best[at, end, n] = n
        for (h_at, h_end, h_n), covered in list(best.items()):
            gained = n - max(0, h_at - (at - n), h_end - (end - n))
            if (h_at, h_end, h_n) < (at, end, n) and gained > 0 and end > h_end and at - n - h_at <= gap and end - n - h_end <= gap:
                best[at, end, n] = max(best[at, end, n], covered + gained)
    return max(best.values(), default=0)


def test_chains_over_all_places(monkeypatch):
    """A passage that recurs in a template, or stands in two, is chained wherever it stands."""
    template = "p q r s t a b c d e u v w x y a b c d e g h i j k"
    scanner = licences.LicenceScanner({"one": [template]})
    assert scanner.scan("u v w x y zz a b c d e zz g h i j k").labels == ["one"]
    rnd = random.Random(8)
    for _ in range(60):
        templates = {str(k): [" ".join(rnd.choice("abc") for _ in range(rnd.randint(8, 25)))] for k in range(3)}
        scanner = licences.LicenceScanner(templates)
        words = [w.encode() for w in (" ".join(rnd.choice([*templates.values()])[0][: rnd.randint(5, 40)] + " " + rnd.choice("abcz") for _ in range(3))).split()]
        found = {t: covered for t, _, _, covered in scanner.chains(scanner.matches(words))}
        for k in range(3):
            assert found.get(k, 0) == best_chain(words, licences.words_of(templates[str(k)][0]), scanner.least, licences.MOST_GAP)


@pytest.mark.parametrize("label", sorted(licences.TEMPLATES))
def test_own_notice(label):
    """Each notice gives its label and, unless a fixed phrase stands in it, no other."""
    for text in licences.TEMPLATES[label]:
        found = licences.default_scanner().scan("before it " + text + " after it")
        assert set(found.labels) - set(found.base_labels) <= {label} and label in found.labels


def test_licence_with_gap():
    words = licences.TEMPLATES["mit"][2].split()
    found = licences.default_scanner().scan(" ".join([*["before"] * 5, *words[:60], "inserted", *words[61:], "after"]))
    assert found.labels == ["mit"] and found.spans[0][1:3] == (5, 168) and found.spans[0][3] > 0.98
    assert licences.default_scanner().scan("permission is granted to go home").labels == []


def test_grammar():
    rnd = random.Random(0)
    strings = []
    for _ in range(300):
        strings.append("ab")
        while rnd.random() < 0.5:
            strings[-1] += "ab"
    m = grammar.infer(strings, 2)
    assert len(m.moves) <= 4
    assert m.log_likelihood("abab") > m.log_likelihood("abba") + 3


def test_credentials():
    detector = secrets_scan.default_detector()
    new = secrets_scan.labelled_credentials(40, seed=99)
    assert sum(detector.score(v)[1] >= 0 for _, v in new) >= 0.9 * len(new)
    plain = ["mail2.example.com", "thanonontioniner1", "4465758382889437a", "version-1.2.3-final", "a1b2", "INV-2024-000123-XX"]
    assert all(detector.score(v)[1] < 0 for v in plain)
    assert secrets_scan.masked("a token = 12345678 b", [(2, 0, 18)]) == "a [REDACTED] b"


def test_kernel():
    marks = toxicity.Landmarks(["idiot", "stupid"])
    near = marks.kernels(["idiot", "idxiot", "table", "", "stuupid"])
    assert near[0][0] == pytest.approx(1) and near[1][0] >= toxicity.LEAST_KERNEL and 2 not in near and 3 not in near and near[4][1] >= toxicity.LEAST_KERNEL
    assert toxicity.letters_of("i.d.i.o.t!") == "idiot" and "i d i o t" in toxicity.tokens_of("an I d i o t here")


def naive_features(word):
    """Subsequences of three of the word's letters between its end marks, by their definition."""
    letters, out = ["^", *word, "$"], {}
    for i in range(len(letters)):
        for j in range(i + 1, min(len(letters), i + 2 + toxicity.MOST_GAP)):
            for k in range(j + 1, min(len(letters), j + 2 + toxicity.MOST_GAP)):
                gaps = (j - i - 1) + (k - j - 1)
                key = letters[i] + letters[j] + letters[k]
                out[key] = out.get(key, 0) + toxicity.DECAY**gaps
    return out


def naive_kernel(a, b):
    x, y = naive_features(a), naive_features(b)
    length = lambda f: sum(v * v for v in f.values()) ** 0.5
    k = sum(v * y.get(c, 0) for c, v in x.items()) / (length(x) * length(y) or 1)
    return k if k >= toxicity.LEAST_KERNEL else 0


def test_kernel_by_its_definition(monkeypatch):
    rnd = random.Random(6)
    names = ["idiot", "stupid", "moron", "trash"]
    words = names + ["".join(rnd.choice("idotsupmrnah") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    for w in names * 20:
        k = rnd.randrange(len(w))
        words.append(w[:k] + rnd.choice("xyz") * rnd.randint(1, 2) + w[k:])
    found = toxicity.Landmarks(names).kernels(words)
    for k, w in enumerate(words):
        assert found.get(k, np.zeros(len(names))) == pytest.approx([naive_kernel(w, n) for n in names], abs=1e-8)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    marks = toxicity.Landmarks(names)
    for w in ["idiot" * 9, "stupid" + "x" * 40, "idiot" + "y" * 16, "moron" * 7 + "z" * 3, *words[:40]]:
        own = marks.long_kernel(w)
        assert (np.zeros(len(names)) if own is None else own) == pytest.approx([naive_kernel(w, n) for n in names], abs=1e-8)


@pytest.mark.parametrize("n", [0, 1, 4090, 4093, 4096, 70_000])
def test_one_rule_for_every_length(n, monkeypatch):
    """Marks don't count, and neither does the length that once changed the rule."""
    m = toxicity.Matcher(toxicity.Landmarks(["idiot"]))
    m.judge({"." * n + "idiot", "idiot" * 820, "idiot" * 819, "idiot" * 14_000})
    assert list(m.near) == ["." * n + "idiot"]


def test_scores_by_their_definition():
    """The score from naive kernels: their sums over tokens, times the machine's weights, through the logistic function."""
    names = ["idiot", "stupid"]
    model = toxicity.ToxicityModel(names, np.array([0.7, -0.2]), -1.5, 1.3, 0.2)
    for text in ["", "an idiot here", "stuupid idi.ot and s t u p i d", "no such thing", "IDIOT! " * 50]:
        tokens = toxicity.tokens_of(text)
        sums = [sum(naive_kernel(toxicity.letters_of(t), n) for t in tokens if toxicity.letters_of(t)) for n in names]
        value = -1.5 + sum(w * toxicity.SCALE * s / (len(tokens) + toxicity.SHORT) for w, s in zip([0.7, -0.2], sums))
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-(1.3 * value + 0.2))), abs=1e-7)


def test_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed int")
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablation(rows, "v1").collect()}
    assert found["few_words"] == (3, 2, 3) and found["repeated_windows"] == (1, 0, 1) and found["symbols"] == (1, 1, 2)
