import io
import tempfile
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from meshframes.llm import token_frames as tf
from meshframes.llm.tokens import Encoder
from meshframes.session import scratch_path
from tests.llm.cases import documents, empty

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(file):
    return Tokenizer.from_file(public_tokenizers.path(file))


@pytest.mark.parametrize("file", FILES)
def test_memo_gives_the_library_ids(file):
    own, lib = Encoder(file), library(file)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abcZ' .,!_%é1\n\t\r\x0b\x1c\x85\xa0  　İΣßñ̃​<|endoftext|>"), max_size=40))
    def check(text):
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids

    check()


@pytest.mark.parametrize("file", FILES)
def test_added_tokens_in_a_text(file):
    own, lib = Encoder(file), library(file)
    for x in (t.content for t in lib.get_added_tokens_decoder().values()):
        for text in (x, f"a {x} b", f"{x}{x}", f"{x} end", f"start {x}", f"Don't{x}'s  {x}\n{x[:-1]}", f"<{x}>", x.upper(), f"e\u0301{x}\u0301", "y" * 60 + x):
            assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    plain = Encoder(file, added_as_text=True)
    lib.encode_special_tokens = True
    assert np.frombuffer(plain.ids([f"a {x} b"])[0], "<u4").tolist() == lib.encode(f"a {x} b", add_special_tokens=False).ids


def test_memo_is_bounded(monkeypatch):
    import meshframes.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    own, lib = Encoder(FILES[0]), library(FILES[0])
    for i in range(40):
        text = " ".join(f"w{i * 7 + j}" for j in range(20)) + " " + "y" * 100
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(own.young) <= 80 and len(own.young.old) <= 80 and not hasattr(own.young.old, "old")


@pytest.mark.parametrize("file", FILES)
def test_texts_together_give_the_library_ids(file, monkeypatch):
    import meshframes.llm.tokens as tokens

    lib = library(file)
    alphabet = st.sampled_from("abÉñ×÷ç,.'<=!  \n\t\r\x1c\xa0\u2003İΣ1½世\u0301\u0338s")

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=alphabet, max_size=30), max_size=6), st.sampled_from([3, 20, 1000]))
    def check(texts, most):
        monkeypatch.setattr(tokens, "BLOCK_CHARS", most)
        texts = [*texts, "", " ", "don't,'s l'été×, a.b,,  \n c÷. <|endoftext|>", "Été, a\n\nb"]
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(file).ids(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]

    check()
    assert Encoder(file).ids([]) == [] and Encoder(file).ids(["", ""]) == [b"", b""]


@pytest.mark.parametrize("file", FILES)
def test_distinct_pieces_are_looked_up_once(file):
    import meshframes.llm.tokens as tokens

    asked = []

    class Asked(tokens.Memo):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    own, texts = Encoder(file), ["some words, été. " * 500, "other words, été. " * 500]
    own.young = Asked(own, {})
    assert np.frombuffer(own.ids(texts)[1], "<u4").tolist() == library(file).encode(texts[1], add_special_tokens=False).ids
    assert len(asked) < 40


@pytest.mark.parametrize("file", FILES)
def test_new_words_are_learnt_together(file, monkeypatch):
    lib, alone = library(file), []
    piece = Encoder.piece
    monkeypatch.setattr(Encoder, "piece", lambda self, x: alone.append(x) or piece(self, x))
    letters = "abcdefgßéüÿÀÖØ"
    words = [x + y + z for x in letters for y in letters for z in letters]
    odd = ["µm", "ªº", "a×b", "c÷", "ñ" * 60, "x" * 47, "x" * 48, "ſt", "ĳs", "ŉ", "  two", "   three  ", "It's", "l'été", "d\n\ne", "Z1é"]
    own = Encoder(file)
    for text in (" ".join(words), " ".join(odd), "  ".join(words[:200]), " ".join([*words[:200], *words[:200], "\xa0", "é\u0301", *odd, *words[::-7]])):
        alone.clear()
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(alone) < 300 and not set(words) & {x.strip(" ") for x in alone if not x.startswith("  ")}


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_reader_unpacks_only_the_frames_it_needs():
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 50_000, n).astype("<u4").tobytes()) for i, n in enumerate([3, 500, 0, 2500, 10, 900, 900])]
    out = io.BytesIO()
    w = tf.FrameWriter(out, frame_ids=1000)
    for d in docs:
        w.add(*d)
    w.close()
    raw = out.getvalue()
    for i, (_, ids) in enumerate(docs):
        r = tf.FrameReader(Source(raw))
        assert r.document(i) == ids
        assert r.frames_read <= 1 + len(ids) // 4000
    assert [(a, n, c) for a, _, n, c in tf.FrameReader(Source(raw))] == [(a, len(b) // 4, zlib.crc32(b)) for a, b in docs]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain.startswith(docs[0][1] + docs[1][1])
    bad = bytearray(raw)
    bad[20] ^= 1
    with pytest.raises(Exception):
        [*tf.FrameReader(Source(bytes(bad)))]


def test_round_trip(spark):
    docs = documents(spark)
    path = scratch_path(spark, "frames-test")
    files = tf.write(docs, path, files=3, frame_ids=500)
    lib = library(FILES[0])
    rows = sorted(tf.read(spark, files).collect(), key=lambda r: r.start)
    want = [(r.doc_id, np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")) for r in docs.collect()]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == sorted((a is not None, a or 0, zlib.crc32(x.tobytes())) for a, x in want)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [x.tolist() for x in tf.fetch(files, 9)] == [x.tolist() for a, x in want if a == 9]
    assert len(tf.fetch(files, 2)) == 2 and tf.fetch(files, 77) == []


def test_empty_table(spark):
    files = tf.write(empty(spark), tempfile.mkdtemp(prefix="run-"), files=2)
    assert files == [] and tf.read(spark, files).count() == 0
