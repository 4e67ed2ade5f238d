import hashlib
import random
import struct

import public_tokenizers
import sentencepiece

from skygrid.llm.piece_offsets import CharacterMap, Normaliser, PieceEncoder, decode_pieces, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", " a  b ", "a▁b ▁ c", "x　y\n z\t", "é̂🏳️‍🌈 \x00 <s> </s> <unk>", "a" * 300 + " " + "b" * 70, "Hello  world", "� ﬁ ½ Å", "one two three " * 300]


def test_ids_equal_the_library_and_spans_cover_the_text():
    own, lib = PieceEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in TEXTS:
        ids = own.pieces(t)
        assert ids == lib.encode(t)
        assert own.pieces(t, part=7) == ids  # long texts, part by part
        starts, stops = own.spans(t.encode(), ids)
        assert (stops >= starts).all() and int((stops - starts).sum()) == len(t.encode())
        raw = t.encode()
        for i, a, z in zip(ids, starts.tolist(), stops.tolist()):
            piece = lib.id_to_piece(i)
            if not lib.is_byte(i) and "▁" not in t:
                assert raw[a:z].decode() in (piece.replace("▁", " "), piece.replace("▁", "", 1).replace("▁", " "))


def trie(words: dict[bytes, int]) -> bytes:
    """A double-array trie by first fit, as the compiled map stores it."""
    units = [0] * 1024
    used, bases = {0}, set()
    kids: dict[bytes, set] = {}
    for w in words:
        for k in range(len(w)):
            kids.setdefault(w[:k], set()).add(w[k])

    def place(prefix: bytes, node: int):
        labels = sorted(kids.get(prefix, ()))
        leaf = prefix in words
        if not labels and not leaf:
            return
        base = next(b for b in range(1, 700) if b not in bases and all((b ^ x) not in used for x in labels) and (not leaf or b not in used))
        bases.add(base)
        units[node] |= (node ^ base) << 10
        if leaf:
            units[node] |= 256
            units[base] = words[prefix] | 1 << 31
            used.add(base)
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] |= x
        for x in labels:
            place(prefix + bytes([x]), base ^ x)

    place(b"", 0)
    return struct.pack(f"<{len(units)}I", *units)


def test_longest_prefix_through_the_compiled_map():
    table = b"X\0yy\0\0"
    blob = trie({b"ab": 0, b"abc": 2, "é".encode(): 5})
    m = struct.pack("<I", len(blob)) + blob + table
    assert CharacterMap(m).longest(b"abcd", 0) == (3, b"yy")
    assert CharacterMap(m).longest(b"abd", 0) == (2, b"X")
    assert CharacterMap(m).longest(b"ba", 0) is None
    out, align = Normaliser(m, dummy_prefix=False)("abc d é ab".encode())
    assert out.decode() == "yy▁d▁▁X"
    assert align.tolist() == [0, 0, 3, 3, 3, 4, 5, 5, 5, 8, 8, 8, 9, 11]
    out, align = Normaliser(m, dummy_prefix=True, squeeze=True)(b"  q   ab ")
    assert out.decode() == "▁q▁X" and align.tolist()[:4] == [2, 2, 2, 2]
    assert Normaliser()(b"")[0] == b"" and Normaliser(b"", squeeze=True)(b"   ")[0] == b""


def test_documents(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "x y", 1), (3, "x y", 1), (99, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(encode_documents(df, MODEL, "digests").collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else ""), len((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    arrays = encode_documents(df, MODEL)
    assert {tuple(r) for r in decode_pieces(arrays, MODEL).collect()} == {(i, lib.decode(lib.encode(t)) if t else "") for i, t, _ in rows}
    assert encode_documents(df.limit(0), MODEL).collect() == []


def test_a_model_with_a_character_map_end_to_end(spark, tmp_path):
    """The shipped model with a map of its own: ids are the library's, spans those of the longest-prefix walk and of the library."""
    from sentencepiece import sentencepiece_model_pb2

    rules = {"é": "e", "éa": "X", "ab": "yy", "abc": "", "ﬁ": "fi", "　": " ", "\t": " "}
    table, words = b"", {}
    for k, v in rules.items():
        words[k.encode()] = len(table)
        table += v.encode() + b"\0"
    units = trie(words)
    for squeeze in (False, True):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as f:
            spec.ParseFromString(f.read())
        spec.normalizer_spec.precompiled_charsmap = struct.pack("<I", len(units)) + units + table
        spec.normalizer_spec.remove_extra_whitespaces = squeeze
        path = str(tmp_path / f"mapped{squeeze}.model")
        with open(path, "wb") as f:
            f.write(spec.SerializeToString())
        own, lib, rng = PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
        assert own.normalise.map.units and not own.by_word
        texts = TEXTS + ["éa é abc ab", "　x　　y", "ﬁne éabc", " \t "] + ["".join(rng.choice("éabcﬁ　 \tz") for _ in range(rng.randint(0, 40))) for _ in range(300)]
        for t in texts:
            ids = own.pieces(t)
            assert ids == lib.encode(t)
            starts, stops = own.spans(t.encode(), ids)
            pieces = lib.encode(t, return_type="proto").pieces
            far = [(p.piece, a, z, p.begin, p.end) for p, a, z in zip(pieces, starts.tolist(), stops.tolist()) if not lib.is_byte(p.id) and p.piece != "▁" and (a, z) != (p.begin, p.end)]
            assert not far, (t, far)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = {r.doc_id: r for r in encode_documents(df, path).collect()}
        assert all(rows[i].ids == lib.encode(t) and rows[i].decoded == lib.decode(lib.encode(t)) for i, t in enumerate(texts) if t)
