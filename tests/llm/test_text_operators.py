"""Operators 1, 2, 3, 7 and 8 against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkscope.llm import bpe, chat, language, packing, quality

DIR = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, words string, row int, mark string"
LONG = ("Spark joins many tables and a shuffle moves rows between tasks. " * 20 + "\n") * 60


def odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (3, LONG, "en", "s", len(LONG)), (None, "Only some words here.", "en", "s", 1), (5, " \n\t ", "fr", "s", 4)]
    return spark.createDataFrame([(*r, True, "w", 7, "m") for r in rows], ODD)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_figures(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", "\n\n", "a a a a a a", "x y z " * 90, " ".join(f"w{i % 80}" for i in range(400)), LONG])], "doc_id long, text string")
    whole = docs.select("doc_id", "text").unionByName(more)
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.judge(whole).collect()}
    assert got == {r.doc_id: base(r.text) for r in whole.collect()}


def test_quality_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality.query(spark, DIR).where("not base_failed").join(labels, "doc_id")
    assert got.where("kept != (quality = 1)").count() == 0


def test_quality_clean_keeps_columns_and_takes_lines_out(spark):
    good = "This is a sentence of plain words that goes on for quite a while. " * 2
    text = "\n".join([" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(6)] + ["Home | About | Contact | Help", "*** ### $$$ *** &&& ***", "Read more", good])
    df = spark.createDataFrame([(1, text, "en", "s", len(text), True, "w", 7, "m")], ODD)
    row = quality.clean(df).first()
    assert row.asDict().keys() == set(df.columns) and row.n_chars == len(row.text)
    assert "About" not in row.text and "###" not in row.text and "Read more" not in row.text and "word5x11." in row.text
    assert quality.clean(odd_rows(spark)).columns == odd_rows(spark).columns
    assert quality.judge(odd_rows(spark)).count() == 6 and quality.judge(odd_rows(spark).limit(0)).count() == 0


PIECES = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "\\", "[", "INST]", "\\[", "[IS]", "[ANS]", "é", " ", "a", "\n"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[IS]"]), PIECES), max_size=6), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns, step):
    template = chat.ChatTemplate()
    writer, reader, got, learnt = chat.TurnMachine(template), chat.ReadMachine(template), [], ""
    for role, text in turns:
        for piece, loss in writer.turn(role, text):
            learnt += template.unescape(piece) if loss else ""
            for at in range(0, len(piece), step):
                got += reader.feed(piece[at : at + step])
    assert got == turns and not reader.held
    assert learnt == "".join(t for r, t in turns if r == "assistant")


def test_chat_query(spark):
    said = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", said), ("assistant", said)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.query(spark, DIR).collect()}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        learnt = "".join(t for r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, None, None, 1), (1, 0, "user", "a", 2), (None, 1, "assistant", "b", 3), (2, None, "user", "x", 4), (2, None, "user", "x", 5)], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: (r.n_turns, r.valid) for r in chat.read_back(chat.formatted(df)).collect()}
    assert got == {1: (2, False), None: (1, False), 2: (2, False)}
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe_equals_the_library(library):
    codec, lib, rng = bpe.word_codec("word_bpe_49k.json"), library["word_bpe_49k.json"], random.Random(3)
    alphabet = [*"abcdeinorstABÉéßİΣσ'’.,!? \n\t\x1c\x85\xa0 漢字12٣½😀́​\x00", "  ", "<|endoftext|>", "<|startoftext|>", "'ll", " the", "ing", "<|"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["a" * 3000, "the" * 2000, "".join(rng.choice("aeinrst") for _ in range(6000)), LONG]
    for text in texts:
        want, ids = lib.encode(text, add_special_tokens=False).ids, list(codec.encode(text))
        assert [int(i) for block in ids for i in block.split()] == want
        assert "".join(codec.decode(ids)) == lib.decode(want, skip_special_tokens=False)


def test_bpe_blocks_need_no_spaces(library, monkeypatch):
    """Cuts fall anywhere: in runs, before combining marks, in special tokens and contractions, and in composed syllables."""
    codec, lib, rng = bpe.word_codec("word_bpe_49k.json"), library["word_bpe_49k.json"], random.Random(11)
    alphabet = ["a", "the", "ing", "é", "e\u0301", "\u0301", "'", "'s", "'ll", "l", "!", "?!", "漢字", "<|endoftext|>", "<|", "7", "٣", "가", "ᄀ", "ᅡ", "ᆨ", "Σ", "İ", " ", "\n"]
    texts = ["".join(rng.choice(alphabet[: rng.choice((4, 9, 25))]) for _ in range(rng.randint(20, 300))) for _ in range(250)]
    for block in (1, 7, 64):
        monkeypatch.setattr(bpe, "BLOCK", block)
        for text in [*texts, "x" * 900, "!" * 700 + "'s" * 40]:
            ids = list(codec.encode(text))
            assert [int(i) for b in ids for i in b.split()] == lib.encode(text, add_special_tokens=False).ids
            assert "".join(codec.decode(ids)) == lib.decode([int(i) for b in ids for i in b.split()], skip_special_tokens=False)


def test_bpe_goes_through_its_machines(monkeypatch):
    """All tokens come out of the transducer, all text out of the decoder, and a run of any length leaves little in the transducer."""
    codec, given_out, most, decoded = bpe.WordCodec(bpe.word_codec("word_bpe_49k.json").path), [], [0], []
    feed, finish, decode = bpe.StreamingEncoder.feed, bpe.StreamingEncoder.finish, bpe.TextDecoder.feed

    def counted(method):
        def call(self, symbols):
            got = method(self, symbols)
            given_out.extend(got)
            most[0] = max(most[0], len(self.text))
            return got

        return call

    monkeypatch.setattr(bpe.StreamingEncoder, "feed", counted(feed))
    monkeypatch.setattr(bpe.StreamingEncoder, "finish", counted(finish))
    monkeypatch.setattr(bpe.TextDecoder, "feed", lambda self, data: decoded.append(decode(self, data)) or decoded[-1])
    monkeypatch.setattr(bpe, "BLOCK", 5000)
    text = "Each of these words differs, once only! " + "".join(random.Random(2).choice("aeinrst") for _ in range(50_000)) + " end"
    ids = list(codec.encode(text))
    assert "".join(codec.decode(ids)) == " ".join(given_out) == "".join(decoded) and len(ids) > 8
    assert most[0] <= 4 * codec.merges.lookahead


def test_bpe_definition():
    """The transducer against joining pairs by rank until none is left."""
    codec, rng = bpe.word_codec("word_bpe_49k.json"), random.Random(4)
    encoder = bpe.StreamingEncoder(codec.merges)
    for _ in range(400):
        piece = "".join(rng.choice("aaeeiinnrsttthing") for _ in range(rng.randint(1, 60)))
        assert encoder.feed(piece[:-1]) + encoder.finish(piece[-1]) == codec.merges.merged([*piece[:-1], piece[-1] + codec.merges.suffix])


def test_bpe_holds_a_bounded_window():
    merges, rng = bpe.word_codec("word_bpe_49k.json").merges, random.Random(5)
    encoder = bpe.StreamingEncoder(merges)
    for symbol in (rng.choice("aeinrst") for _ in range(5000)):
        list(encoder.feed([symbol]))
        assert len(encoder.text) <= 8 * merges.lookahead


def test_text_decoder_waits_for_characters():
    data, decoder = "aé漢😀".encode() + b"\xff", bpe.TextDecoder()
    assert "".join(decoder.feed(data[i : i + 1]) for i in range(len(data))) + decoder.finish() == data.decode("utf-8", "replace")


def test_bpe_query(spark, library):
    lib = library["word_bpe_49k.json"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in bpe.query(spark, DIR).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    odd = {r.doc_id: r.n_tokens for r in bpe.encoded(odd_rows(spark)).collect()}
    assert odd[1] == odd[2] == odd[5] == 0 and odd[3] > 0 and odd[None] > 0


def test_packing(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 1 << 16)
    lib = library["byte_bpe_50k.json"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a  b \n c<|endoftext|> d "), (-4, LONG), (-5, " " * 3000 + "y")], "doc_id long, text string")
    whole = docs.unionByName(more)
    pieces = packing.digest(packing.pack(whole)).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for r in whole.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(whole.limit(0)).count() == 0
    assert packing.pack(odd_rows(spark)).count() >= 6


def test_packing_encoder_in_blocks(library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 100)
    lib, own = library["byte_bpe_50k.json"], packing.Encoder("byte_bpe_50k.json")
    for text in ["", " ", " " * 5000 + "x", "one  two\tthree 'll  don't\n\n x " * 200, "a" * 3000, "a<|endoftext|> b " * 30, "漢字かな " * 90, "x y" + " " * 150 + "z w " * 60]:
        assert np.frombuffer(own.encode(text), dtype="<u2").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.train(docs)
    got = language.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if language.in_fold(r.doc_id)]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    odd = odd_rows(spark).unionByName(spark.createDataFrame([(9, "123 !!", "en", "s", 6, True, "w", 7, "m")], ODD))
    preds = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, network).collect()}
    assert preds[1] == preds[2] == preds[5] == preds[9] == ("und", 0.0) and preds[3][0] == "en"
    assert language.confident(odd).columns == odd.columns
    assert language.train(odd.limit(0)) is None and language.predict(odd, None).where("lang_pred != 'und'").count() == 0


def test_language_network_by_hand():
    """The forward pass against loops over windows, filters and places, and the gradients against small steps."""
    rules = language.LanguageRules(window=9, embedding=3, widths=(2, 3), filters=4)
    network = language.ByteNetwork(rules, ["aa", "bb", "cc"])
    for name in ("embed", "out", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    network.kernels, network.shifts = [k.astype(np.float64) for k in network.kernels], [s + np.linspace(-0.1, 0.2, 4) for s in network.shifts]
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(0, 256, (5, rules.window)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    windows[0, 6:] = 0

    def by_hand(window):
        pooled = []
        for width, kernel, shift in zip(rules.widths, network.kernels, network.shifts, strict=True):
            for f in range(rules.filters):
                answers = [sum(network.embed[window[at + j], e] * kernel[j * 3 + e, f] for j in range(width) for e in range(3)) for at in range(rules.window - width + 1)]
                pooled.append(max(max(answers) + shift[f], 0))
        z = [sum(h * network.out[i, c] for i, h in enumerate(pooled)) + network.bias[c] for c in range(3)]
        return np.array(z) - np.log(sum(np.exp(z)))

    assert np.allclose(network.log_softmax(windows), [by_hand(w) for w in windows])
    loss = lambda: -network.log_softmax(windows)[np.arange(5), labels].mean()
    for weight, gradient in zip(network.weights(), network.gradients(windows, labels), strict=True):
        for place in [*zip(*np.nonzero(gradient), strict=True)][:6]:
            weight[place] += 1e-5
            above = loss()
            weight[place] -= 2e-5
            below = loss()
            weight[place] += 1e-5
            assert abs((above - below) / 2e-5 - gradient[place]) < 1e-6
