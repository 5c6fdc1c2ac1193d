"""Operator 3, BPE encoding and decoding as streaming transducers.

Encoding reads symbols from left to right and keeps, for each prefix, the last token of that prefix's encoding. A token may follow
another only if the two, spelt out together, are encoded as just these two; that makes the last token of each prefix unique. The lookahead
that suffices is the width of the longest token, ``lookahead`` symbols: whatever comes later follows some prefix's encoding, and the token
that covers the present end begins behind one of the last ``lookahead`` prefixes. A boundary on which the chains of all these agree is
therefore in every continuation: it is stable, the tokens before it are emitted, and their state is dropped. Memory depends on the merge
list, not on the text.

Every token comes from the transducer. What it gave for a short piece is remembered, up to a bound, in each worker. Long texts are read in
blocks, cut where no normal form, special token or contraction reaches over; a run of letters or signs that a cut interrupts stays in the
transducer until its end, so that texts without spaces take no more memory.

Decoding is a state machine from bytes to text that holds back an unfinished character. Vocabularies without a decoder are decoded to
their token strings, joined by spaces.

Defined results: a null or empty text has no tokens, and decodes to ''; repeated rows give repeated rows; a null id is kept; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import quoted

#: White space as the library's patterns understand it.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Remembered pieces of a worker, and the longest of them.
REMEMBERED, LONGEST = 500_000, 48
#: Characters of a text that are turned into tokens and hashed at a time.
BLOCK = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a tokenizer file with byte-level symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.digits = {t: str(i) for t, i in (self.ids | self.special).items()}
        self.names = {i: t for t, i in self.digits.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.lookahead = max(self.width(t) for t in self.ids)
        # What a token without the suffix can begin with, and whether it is one.
        self.open: dict[str, bool] = {t[:n]: t[:n] in self.ids for t in self.ids for n in range(1, self.width(t) + 1)}
        self.agreed: dict[tuple[str, str], bool] = {}

    def width(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and token != self.suffix else 0)

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            bare = token[: -len(self.suffix)]
            return [*bare[:-1], bare[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def agree(self, a: str, b: str) -> bool:
        got = self.agreed.get((a, b))
        if got is None:
            if len(self.agreed) > 4 * REMEMBERED:
                self.agreed.clear()
            got = self.agreed[a, b] = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        return got


class StreamingEncoder:
    """Tokens of one piece after another, symbol by symbol.

    ``text`` holds the symbols since the last stable boundary, ``last`` the last token of the encoding of each of their prefixes, and
    ``starts`` the places where a token that is still open can have begun.
    """

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        self._begin()

    def _begin(self) -> None:
        self.text, self.last, self.starts = "", [""], []

    def feed(self, symbols: str) -> list[str]:
        """Symbols that are followed by others; gives the tokens that have become stable."""
        opened, agree, agreed, most, out = self.merges.open, self.merges.agree, self.merges.agreed, 4 * self.merges.lookahead, []
        text, last, starts = self.text, self.last, self.starts
        for symbol in symbols:
            starts.append(len(text))
            text += symbol
            still, found = [], ""
            for start in starts:
                token = text[start:]
                is_token = opened.get(token)
                if is_token is None:
                    continue
                still.append(start)
                if is_token and not found:
                    before = last[start]
                    if not before or (ok := agreed.get((before, token))) or ok is None and agree(before, token):
                        found = token
            if not found:
                raise ValueError(f"no token ends in {symbol!r}")
            last.append(found)
            starts = still
            if len(text) >= most:
                self.text, self.starts = text, starts
                out += self._stable()
                text, last, starts = self.text, self.last, self.starts
        self.text, self.starts = text, starts
        return out

    def finish(self, symbol: str) -> list[str]:
        """The last symbol of the piece; gives the tokens that are left, and is ready for the next piece."""
        ids, agree, suffix, text = self.merges.ids, self.merges.agree, self.merges.suffix, self.text + symbol
        for start in (*self.starts, len(text) - 1):
            token = text[start:] + suffix
            if token in ids and (not self.last[start] or agree(self.last[start], token)):
                break
        else:
            raise ValueError(f"no token ends in {symbol!r}")
        tokens = [*self._chain(start), token]
        self._begin()
        return tokens

    def _chain(self, at: int) -> list[str]:
        tokens, last, width = [], self.last, self.merges.width
        while at > 0:
            tokens.append(last[at])
            at -= width(last[at])
        return tokens[::-1]

    def _stable(self) -> list[str]:
        """Walks the chains of all prefixes that can still be continued back to where they meet."""
        live = set(range(len(self.text) - self.merges.lookahead + 1, len(self.text) + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - self.merges.width(self.last[top]))
        at = live.pop()
        tokens = self._chain(at)
        # The prefix that ends at the boundary keeps its last token: what follows must agree with it.
        self.text, self.last, self.starts = self.text[at:], self.last[at:], [start - at for start in self.starts if start >= at]
        return tokens


class TextDecoder:
    """Bytes in, text out: an unfinished character waits for its rest, a broken one becomes U+FFFD."""

    def __init__(self) -> None:
        import codecs

        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@cache
def _joining() -> frozenset[str]:
    """Characters that a normal form can join to, or move before, what precedes them."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


class WordCodec:
    """The word vocabulary: lower case, white space dropped, word ends marked; its decoder is plain."""

    def __init__(self, path: str) -> None:
        self.path, self.merges = path, MergeList(path)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.piece = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        # For texts of these characters alone, which are in normal form, the standard library's classes mean the same and are faster.
        self.plain = re.compile(r"[^\x00-\x7f\xc0-\u024f\u2013-\u201d\u2026\u20ac]")
        self.plain_piece = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^{WHITE}\w]|_)+")
        # Runs that a block's end can interrupt.
        self.runs = (regex.compile(r"\p{L}+"), regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]+"))
        self.pieces = _Pieces(self)
        self.bytes = {i: t.encode() for i, t in self.merges.names.items()}

    def symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)

    @staticmethod
    def normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ids(self, text: str) -> Iterator[str]:
        """Ids of the pieces of a text."""
        for plain in self.cut.split(text) if "<|" in text else [text]:
            if plain in self.merges.special:
                yield self.merges.digits[plain]
            elif self.plain.search(plain):
                yield from map(self.pieces.__getitem__, self.piece.findall(self.normal(plain)))
            else:
                yield from map(self.pieces.__getitem__, self.plain_piece.findall(plain.lower()))

    def boundary(self, text: str, at: int) -> int:
        """The first place from at on that no normal form, special token or contraction reaches over."""
        joining = _joining()
        while at < len(text):
            if text[at] in joining or unicodedata.combining(text[at]) or any(text[at - n : at - n + 1] == "'" != text[at - n - 1 : at - n] for n in (1, 2)):
                at += 1
                continue
            over = [at + n for t in self.merges.special for n in range(1, len(t)) if text.startswith(t, at - len(t) + n)]
            if not over:
                break
            at = max(over)
        return min(at, len(text))

    def blocks(self, text: str) -> Iterator[str]:
        """Ids, block by block, of a long text. A run that goes on beyond its block stays in the transducer, a short one waits for its rest."""
        at, rest, encoder, open_run, held = 0, "", None, None, ""
        digits = self.merges.digits.__getitem__
        while at < len(text):
            end = self.boundary(text, at + BLOCK)
            out: list[str] = []
            parts = self.cut.split(text[at:end])
            for n, part in enumerate(parts):
                special = part in self.merges.special
                part = part if special else rest + self.normal(part)
                rest = "" if not special else rest
                if open_run is not None:
                    more = None if special else open_run.match(part)
                    if more:
                        symbols = held + self.symbols(more[0])
                        out += map(digits, encoder.feed(symbols[:-1]))
                        held, part = symbols[-1], part[more.end() :]
                    if part or special:
                        out += map(digits, encoder.finish(held))
                        open_run = None
                if special:
                    out.append(digits(part))
                    continue
                last = n == len(parts) - 1 and end < len(text)
                for piece in self.piece.finditer(part):
                    run = next((r for r in self.runs if r.fullmatch(piece[0])), None) if last and piece.end() == len(part) else None
                    if run is None:
                        out.append(self.pieces[piece[0]])
                    elif len(piece[0]) <= LONGEST:
                        rest = piece[0]
                    else:
                        encoder, symbols = StreamingEncoder(self.merges), self.symbols(piece[0])
                        out += map(digits, encoder.feed(symbols[:-1]))
                        open_run, held = run, symbols[-1]
            at = end
            if out:
                yield " ".join(out)
        if open_run is not None:
            yield " ".join(map(digits, encoder.finish(held)))

    def encode(self, text: str) -> Iterator[str]:
        """Ids, decimal and joined by spaces, block by block."""
        if len(text) > BLOCK:
            yield from self.blocks(text)
        elif ids := " ".join(self.ids(text)):
            yield ids

    def decode(self, ids: Iterable[str]) -> Iterator[str]:
        """The text of ids as encode gives them, block by block: token strings joined by spaces, as bytes through the decoder's states."""
        decoder, lead = TextDecoder(), b""
        for block in ids:
            yield decoder.feed(lead + b" ".join(map(self.bytes.__getitem__, block.split(" "))))
            lead = b" "
        yield decoder.finish()


class _Pieces(dict):
    """Ids of pieces, decimal and joined by spaces, as the transducer gave them; pieces of over LONGEST characters go through it each time."""

    def __init__(self, codec: WordCodec) -> None:
        self.codec, self.encoder = codec, StreamingEncoder(codec.merges)

    def __missing__(self, piece: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        symbols, encoder = self.codec.symbols(piece), self.encoder
        got = " ".join(map(self.codec.merges.digits.__getitem__, encoder.feed(symbols[:-1]) + encoder.finish(symbols[-1])))
        if len(piece) <= LONGEST:
            self[piece] = got
        return got


@cache
def word_codec(name: str) -> WordCodec:
    import public_tokenizers

    return WordCodec(public_tokenizers.path(name))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array, if asked for), n_tokens, and digests of the ids and of the text they decode to."""
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                ids_sum, text_sum, n, kept = sha256(), sha256(), 0, []

                def passed(blocks: Iterator[str]) -> Iterator[str]:
                    nonlocal n, kept
                    for block in blocks:
                        ids_sum.update((b" " if n else b"") + block.encode())
                        n += block.count(" ") + 1
                        if with_ids:
                            kept += map(int, block.split(" "))
                        yield block

                for decoded in codec.decode(passed(codec.encode(text.as_py() or ""))):
                    text_sum.update(decoded.encode())
                out.append((kept, n, ids_sum.hexdigest(), text_sum.hexdigest()))
            ids, n, a, b = zip(*out, strict=True) if out else ((), (), (), ())
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if not with_ids:
                del columns["ids"]
            yield pa.RecordBatch.from_pydict(columns)

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, {'ids array<int>, ' if with_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document of the table."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).select("doc_id", "n_tokens", F.col("ids_sha256"), "decoded_sha256")
