"""Token ids of public tokenizers, a batch of texts at a time.

Both encoders cut a text where their tokenizer cuts it anyway and encode each
distinct piece once by the tokenizer's own model, so the ids equal those of the
whole text. The ids of recent pieces are remembered per Python worker. The
vocabulary path is a parameter.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_STOPS = frozenset(".,;:!?")


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def to_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return np.asarray(ids, "<u4").tobytes()


class Encoder(dict):
    """Remembers the ids (as `to_bytes`) of pieces. `cut` gives a text as its pieces with
    SEP between them, or None if it has to be encoded as a whole."""

    SEP: str
    PIECES = 300_000  # pieces remembered per Python worker

    def cut(self, text: str) -> str | None:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> None:
        raise NotImplementedError

    def encode(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        if len(self) > self.PIECES:
            self.clear()
        cuts = [self.cut(v) for v in values]
        lists = pc.split_pattern(pa.array([c or "" for c in cuts], pa.large_string()), self.SEP)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        found = [*map(self.get, pieces)]
        if None in found:
            new = [i for i, f in enumerate(found) if f is None]
            self.learn([pieces[i] for i in new])
            for i in new:
                found[i] = self[pieces[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy()
        length = sizes[at]
        ends = np.cumsum(length)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - length)
        out = ids[np.repeat(first, length) + np.arange(ends[-1] if len(ends) else 0)]
        n_pieces = np.cumsum(lists.value_lengths().to_numpy())
        counts = np.diff(np.concatenate(([0], ends))[np.concatenate(([0], n_pieces))])
        if None in cuts:
            parts = np.split(out, np.cumsum(counts)[:-1])
            parts = [p if c is not None else np.frombuffer(self.whole(v), "<u4")
                     for p, c, v in zip(parts, cuts, values)]
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out, counts


class WordBpe(Encoder):
    """A BPE with word ends that lower-cases and drops white space (a `tokenizers` file).

    The text is normalised as the tokenizer does it (NFC, lower case) and cut at
    blanks and line feeds, where every word ends. A new chunk is cut by the
    tokenizer's own pattern into units, and the ids of a unit, up to the one that ends
    a word, come from its BPE model.
    """

    SEP = " "
    _PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def whole(self, text: str) -> bytes:
        return to_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut(self, text: str) -> str | None:
        if any(s in text for s in self.special):
            return None
        if "Σ" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()  # letter by letter as in the tokenizer, but for a final sigma
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
        return text.replace("\n", " ")

    def _units(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._PATTERN.findall(chunk)

    def learn(self, pieces: list[str]) -> None:
        units = {c: self._units(c) for c in pieces}
        new = list({u for own in units.values() for u in own if u not in self})
        for at in range(0, len(new), 1000):
            part = new[at:at + 1000]
            ids = np.array(self.model.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(part):
                raise ValueError("a unit did not end in one word end")
            raw = ids.tobytes()
            self.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
        for c, own in units.items():
            if len(own) != 1 or own[0] != c:
                self[c] = b"".join([self[u] for u in own])


class ByteBpe(Encoder):
    """A byte-level BPE (a `tiktoken` rank file); lossless, control strings are ordinary text.

    The pattern's pieces never hold white space after other characters, so a text
    is cut there into chunks, which are encoded one by one.
    """

    SEP = "\x00"
    PIECES = 1_000_000
    _CHUNK = regex.compile(r"\s*\S+|\s+")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = len(ranks)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return to_bytes(self.encoding.encode_ordinary(text))

    def cut(self, text: str) -> str | None:
        flat = text.replace("\n", " ")
        if flat.isprintable() and "  " not in flat and flat[:1] != " " and flat[-1:] != " ":
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n")  # single blanks and line feeds
        return None if "\x00" in text else "\x00".join(self._CHUNK.findall(text))

    def _piece(self, chunk: str) -> bytes:
        found = self.get(chunk)
        if found is None:
            if chunk[-1:] in _STOPS and chunk[:-1].lstrip(" ").isalpha():
                found = self._piece(chunk[:-1]) + self._piece(chunk[-1])
            else:
                found = self.whole(chunk)
            self[chunk] = found
        return found

    def learn(self, pieces: list[str]) -> None:
        for p in pieces:
            self._piece(p)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class JsonByteBpe(ByteBpe):
    """The same tokenizer from a `tokenizers` file whose ids are the ranks of its merges.

    `pieces[i]` are the bytes of id i. Special tokens in a text are ordinary text.
    """

    PIECES = 250_000

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        dict.__init__(self)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids are not in the order of the merges")
        # bytes that print stand for themselves, the others for code points from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
        plain = {t: i for t, i in vocab.items() if all(c in byte for c in t)}
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
        self.size = max(ranks.values()) + 1
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("not every byte is a token")
        self.pieces = [b""] * self.size
        for raw, i in ranks.items():
            self.pieces[i] = raw
        self.encoding = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> str | None:
        if text[:1] == " " and text[1:2] != " ":
            rest = super().cut(text[1:])
            if rest is not None and rest[:1] not in ("\n", "\x00"):
                return " " + rest  # the first chunk takes the blank before it
            return None if "\x00" in text else "\x00".join(self._CHUNK.findall(text))
        return super().cut(text)


class PieceBpe(Encoder):
    """A BPE with byte fallback and without normalisation (a `sentencepiece` model),
    given texts with the blank in front that the model would add.

    No piece of the vocabulary holds a blank after another character or a line feed, so a
    text is cut before blanks and around line feeds. `pieces[i]` are the bytes of id i.
    """

    SEP = "\x00"
    PIECES = 250_000
    _CHUNK = regex.compile(r" *[^ \n]+| +|\n")

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        super().__init__()
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("the model normalises its texts")
        spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        byte = pb.ModelProto.SentencePiece.BYTE
        self.pieces = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte
                       else p.piece.replace("▁", " ").encode("utf-8") for p in proto.pieces]
        self.size = len(self.pieces)
        self.lossy = False  # whether the bytes of something remembered differ from it
        self.apart = not any("\n" in p.piece or regex.search("[^▁]▁", p.piece) for p in proto.pieces)

    def _checked(self, text: str, ids: list[int]) -> bytes:
        self.lossy |= b"".join([self.pieces[i] for i in ids]) != text.encode("utf-8")
        return to_bytes(ids)

    def whole(self, text: str) -> bytes:
        return self._checked(text, self.processor.encode(text, num_threads=1))

    def clear(self) -> None:
        super().clear()
        self.lossy = False

    def cut(self, text: str) -> str | None:
        if not self.apart or "\x00" in text:
            return None
        if "  " not in text and " \n" not in text:
            return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")  # empty pieces have no ids
        return "\x00".join(self._CHUNK.findall(text))

    def learn(self, pieces: list[str]) -> None:
        for p, ids in zip(pieces, self.processor.encode(pieces, num_threads=1)):
            self[p] = self._checked(p, ids)


@cache
def json_byte_bpe(path: str) -> JsonByteBpe:
    return JsonByteBpe(path)


@cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)
