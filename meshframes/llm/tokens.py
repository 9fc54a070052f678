"""Token ids of whole texts by a public tokenizer file, with a bounded memo of words.

Both vocabularies cut a text before every run of white space that follows another character
(no token reaches over that place), so ids of a text are the ids of its pieces
``[white space]*[other characters]+`` one after the other, and a piece seen before costs a lookup.
Texts are encoded many at a time: their pieces, which also end where a sign follows a letter, lie one after the other in
the joined bytes, so Arrow finds the distinct ones and puts their ids in place, and only distinct pieces are looked up.
Of pieces that are one plain word with or without signs after it, the model alone is asked (its input is the word as
the file's normalizer and byte alphabet leave it), which is several times as fast as the whole chain; new words of a
block are brought into that form together and the model is asked for them in one loop.
Strings of the file's added tokens in a text are those tokens, as the library has it (or ordinary text, if
that is asked for): the text is cut at them first, and what lies between is encoded as a text of its own.
The memo lives as long as its Python worker has tasks of one stage, as a worker would hold it through all later stages; it keeps the pieces used last and is bounded by
:data:`MEMO` pieces, and those of one block of texts, of at most :data:`LONGEST` characters in each of two generations.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from meshframes.llm.common import blocks, kept_in_stage

#: Unicode White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space or none, letters that stand for themselves in NFC and have one lower-case letter, and signs but apostrophes.
PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Characters that stand for the bytes of a word in both files: printable ones for themselves, the others from U+0100 on in their order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
SPACE = ALPHABET[32]
BYTES = "".join(ALPHABET.get(b, chr(b)) for b in range(256))
#: Words that the model alone is asked for, many at a time.
WORD = re.compile(" *[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The signs that a plain word may end with.
SIGNS = frozenset(x for x in map(chr, range(33, 127)) if not x.isalnum() and x != "'")
#: Characters outside of those that Python lower-cases and splits at as the "lower" kind of file does.
OTHER = re.compile("[^\x00-\x1b -\u012f\u0131-\u017f\u2010-\u2027]")
#: These and white space outside of ASCII.
APART = re.compile("[^\x00-\x1b -\x84\x86-\x9f\xa1-\u012f\u0131-\u017f\u2010-\u2027]")
#: White space outside of ASCII; texts with it are cut one by one.
FAR_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Where a long text may be cut.
BEFORE_WHITE = re.compile("(?<=[^\t-\r ])(?=[\t-\r ])")
IS_WHITE = np.isin(np.arange(256), [*range(9, 14), 32])
IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Last bytes of the letters of two bytes that begin with 0xC3: all but the signs U+00D7 and U+00F7.
IS_LAST = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
IS_SIGN = np.isin(np.arange(256), [x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"])
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Characters that are encoded at a time.
BLOCK_CHARS = 4_000_000
MEMO = 350_000
BLOCK_PIECES = 100_000
LONGEST = 48


class Memo(dict):
    """Ids by piece; learns a piece when it is asked for, or tells None of a new one while it does not learn."""

    learning = True

    def __init__(self, encoder: Encoder, old: dict[str, bytes]) -> None:
        self.encoder, self.old = encoder, old

    def __missing__(self, piece: str) -> bytes | None:
        v = self.old.get(piece)
        if v is None:
            if not self.learning:
                return None
            v = self.encoder.piece(piece)
            if len(piece) > LONGEST:
                return v
        self[piece] = v
        return v


class Encoder:
    def __init__(self, file: str, added_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.tokenizer.encode_special_tokens = True  # a text is cut at added tokens before; pieces, which may be lower-cased, hold none
        added = {} if added_as_text else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {x: self._bytes([i]) for x, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # the two kinds of file for which plain words are understood: nothing normalized, or case and white space dropped
        self.plain = {"byte_bpe_50k.json": "exact", "word_bpe_49k.json": "lower"}.get(os.path.basename(file))
        self.around: dict[str, bytes] = {"": b""}
        self.young = Memo(self, {})

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        if self.plain == "exact" and len(piece) <= LONGEST and piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            return self._bytes([t.id for t in self.tokenizer.model.tokenize(SPACE + piece[1:])])
        if self.plain == "lower":
            piece = piece.strip(" ")
        if self.plain == "lower" and piece.isascii() and len(piece) <= LONGEST:  # most pieces, without the chain below
            if piece.isalpha():
                return self._bytes([t.id for t in self.tokenizer.model.tokenize(piece.lower())])
            if piece[:-1].isalpha() and piece[-1] in SIGNS:
                if piece[-1] not in self.around:
                    self.around[piece[-1]] = self._whole(piece[-1])
                return self.young[piece[:-1]] + self.around[piece[-1]]
        m = self.plain and PLAIN.fullmatch(piece)
        if not m or len(piece) > LONGEST:
            return self._whole(piece)
        before, word, after = m.groups()
        around = self.around
        if self.plain == "lower":
            before, word = "", word.lower()
        elif before == " ":
            before, word = "", " " + word
        for x in (before, after):
            if x not in around:
                around[x] = self._whole(x)
        if not word.isascii() or word[0] == " ":
            word = word.encode().decode("latin-1").translate(ALPHABET)
        return around[before] + self._bytes([t.id for t in self.tokenizer.model.tokenize(word)]) + around[after]

    @staticmethod
    def _bytes(ids: list[int] | array) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        if self.plain == "lower" and not OTHER.search(text):
            return text.lower().split()
        return PIECE.findall(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        joined = [i for i, t in enumerate(texts) if self._joins(t)]
        if len(joined) < len(texts):
            out = [b""] * len(texts)
            for i, x in zip(joined, self._many([texts[i] for i in joined])):
                out[i] = x
            for i in sorted(set(range(len(texts))) - set(joined)):
                out[i] = self._text(texts[i])
            return out
        return self._many(texts)

    def _joins(self, text: str) -> bool:
        """Whether the text can be cut as bytes: a file whose cuts are known, ASCII white space only, no added token."""
        if not self.plain or any(x in text for x in self.added):
            return False
        if text.isascii():
            return self.plain != "lower" or not any(x in text for x in "\x1c\x1d\x1e\x1f")
        return not (APART if self.plain == "lower" else FAR_WHITE).search(text)

    def _many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that join."""
        out: list[bytes] = []
        for s, e in blocks([len(t) for t in texts], BLOCK_CHARS):
            if e - s > 1 or len(texts[s]) <= BLOCK_CHARS:
                out += self._block(texts[s:e])
                continue
            parts, at = [], 0
            while at < len(texts[s]):
                cut = BEFORE_WHITE.search(texts[s], at + BLOCK_CHARS)
                end = cut.start() if cut else len(texts[s])
                parts += self._block([texts[s][at:end]])
                at = end
            out.append(b"".join(parts))
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        if self.plain == "lower":  # white space makes no token, so each word may stand behind one space
            raw = [b" " + t.lower().encode().translate(SPACES) for t in texts]
        else:
            raw = [t.encode() for t in texts]
        data, begins = b"".join(raw), np.cumsum([0, *map(len, raw)])
        if not data:
            return [b""] * len(texts)
        a = np.frombuffer(data, np.uint8)
        white = a == 32 if self.plain == "lower" else IS_WHITE[a]
        cut = np.zeros(len(a) + 1, bool)
        cut[1:-1] = white[1:] & ~white[:-1]
        # no token reaches from a letter to a sign
        sign = np.flatnonzero(IS_SIGN[a])
        before, two = a[np.maximum(sign - 1, 0)], a[np.maximum(sign - 2, 0)]
        cut[sign[(sign > 0) & (IS_LETTER[before] | (sign > 1) & (two == 0xC3) & IS_LAST[before])]] = True
        cut[begins] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        known = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        flat, at = memoryview(ids.buffers()[2] or b""), ends[np.searchsorted(starts, begins)].tolist()
        return [bytes(flat[s:e]) for s, e in zip(at, at[1:])]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        if len(self.young) > MEMO:
            self.young = Memo(self, dict(self.young))
        memo = self.young
        if not self.plain:
            return [memo[p] for p in pieces]
        memo.learning = False
        known = [memo[p] for p in pieces]
        memo.learning = True
        new = [i for i, v in enumerate(known) if v is None]
        self._learn([pieces[i] for i in new])
        for i in new:
            known[i] = memo[pieces[i]]
        return known

    def _learn(self, pieces: list[str]) -> None:
        """Puts new pieces that are one word into the memo: the model is asked for them in one loop. Others are learnt when they are asked for."""
        one = WORD.fullmatch
        words = [p for p in dict.fromkeys(pieces) if len(p) <= LONGEST and one(p) and (self.plain == "lower" or p[:2] != "  ")]
        if not words:
            return
        text = "\n".join(words)
        if self.plain == "lower":
            text = text.replace(" ", "").lower()
        ask = self.tokenizer.model.tokenize
        flat, ends = array("I"), [0]
        for word in codecs.charmap_decode(text.encode(), "strict", BYTES)[0].split(ALPHABET[10]):
            flat.extend([t.id for t in ask(word)])
            ends.append(4 * len(flat))
        data = self._bytes(flat)
        self.young.update(zip(words, [data[s:e] for s, e in zip(ends, ends[1:])]))

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return b"".join(self.added[x] if i % 2 else self._plain_text(x) for i, x in enumerate(self.cut.split(text)))
        return self._plain_text(text)

    def _plain_text(self, text: str) -> bytes:
        pieces = self._pieces(text)
        parts = []
        for i in range(0, len(pieces), BLOCK_PIECES):
            parts.append(b"".join(self._known(pieces[i : i + BLOCK_PIECES])))
        return parts[0] if len(parts) == 1 else b"".join(parts)


@kept_in_stage
def encoder(file: str) -> Encoder:
    """One encoder for each file, Python worker and stage."""
    return Encoder(file)
