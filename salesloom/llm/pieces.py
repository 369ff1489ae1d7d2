"""SentencePiece encoding and decoding, exactly, by backtracking over longest matches.

A merge-type model joins, again and again, the adjacent pair whose joined piece has the best score (the left one
on ties). Its result is the only split of a text into reachable pieces in which every two neighbours are what
merging their joined text gives back: merges inside a span never depend on what lies outside, so a first merge
across a border in the whole text would also happen in the two pieces alone. Encoding therefore walks the text
once: take the longest piece that starts here (Aho-Corasick), keep it if it is compatible with the piece before
it, else try the next shorter one, and step back where none fits. Positions from which nothing fits are marked in
a bitfield and never tried again, which keeps the work linear in practice.

No piece of the model has a space mark after another character, and characters that occur in no longer piece never
merge, so texts fall apart at spaces and line breaks into units that are encoded alone and remembered (in a
dictionary of bounded size). The whole text is encoded, whatever its length.

Null and empty texts have only the begin and end ids. Repeated rows give repeated rows, an empty table an empty one;
extra columns of any name are left out of the query and kept by `encode_texts`.
"""

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from salesloom.llm.common import fresh, ship

SPACE = "▁"
#: Units remembered by a Python worker in each of two generations, where the caller doesn't say: more take memory (about 350
#: bytes each) and save time.
REMEMBERED = 80_000
_LOADED: dict[str, "Codec"] = {}


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kinds = proto.ModelProto.SentencePiece
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models with identity normalization are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix, self.remembered = norm.add_dummy_prefix, remembered
        self.pieces = [p.piece for p in spec.pieces]
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        byte_ids = [i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE]
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in byte_ids}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()} if spec.trainer_spec.byte_fallback else {}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        named = {p.type: i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN}
        self.unknown, self.unknown_text = named[kinds.UNKNOWN], spec.trainer_spec.unk_surface
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id

        # Only pieces that merging really gives can stand in a result.
        self.reachable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.reachable.items():
            self.matches.add_word(piece, (i, len(piece)))
        self.matches.make_automaton()
        self.shorter = {}
        for piece, i in self.reachable.items():
            cut = next((n for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.reachable), 0)
            self.shorter[i] = self.reachable[piece[:cut]] if cut else -1
        self.widths = [len(p) for p in self.pieces]
        self.widest = max(map(len, self.reachable))
        self.compatible: dict[int, bool] = {}
        longer = [p for p in self.ids if len(p) > 1]
        self.by_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer)
        self.by_line = not any("\n" in p for p in longer)
        self.units = _Memo(self._unit, remembered)
        self.segments = _Memo(self._ids, remembered)
        self.plain = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.edge = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives the same two pieces; unknown characters merge with nothing."""
        pair = left << 24 | right
        if (known := self.compatible.get(pair)) is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.compatible) >= 4 * self.remembered:
                self.compatible.clear()
            known = self.compatible[pair] = self.merged(a + b) == [a, b]
        return known

    def longest_matches(self, text: str) -> tuple[list[int], int]:
        """The longest piece from every border on, as far as neighbours are compatible, and where that ends."""
        out, at, known, before = [], 0, self.compatible, -1
        for last, (i, n) in self.matches.iter_long(text):
            if last - n + 1 != at:
                break  # a character without a piece
            if before >= 0:
                pair = before << 24 | i
                if not (known[pair] if pair in known else self._fits(before, i)):
                    break
            out.append(i)
            at += n
            before = i
        return out, at

    def _longest(self, text: str, at: int) -> int:
        for n in range(min(self.widest, len(text) - at), 0, -1):
            if (i := self.reachable.get(text[at:at + n])) is not None:
                return i
        return -1

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text without begin and end; characters without a piece have id -1 - position."""
        out, at = self.longest_matches(text)
        size = len(text)
        if at == size:
            return out
        dead = bytearray(size // 8 + 1)
        token = self._longest(text, at)
        while at < size:
            if token == -1 and text[at] not in self.reachable:  # no piece covers it, so none beside it can merge with it
                out.append(-1 - at)
                at += 1
                token = self._longest(text, at) if at < size else -1
                continue
            before = out[-1] if out else -1
            while token >= 0:
                then = at + self.widths[token]
                if not dead[then >> 3] >> (then & 7) & 1 and (before < 0 or self._fits(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = then
                token = self._longest(text, at) if at < size else -1
            else:
                dead[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= self.widths[token]
                token = self.shorter[token]
        return out

    def _ids(self, text: str) -> bytes:
        found = self.backtrack(text)
        if min(found, default=0) >= 0:
            return struct.pack(f"<{len(found)}I", *found)
        out = []
        for i in found:
            if i >= 0:
                out.append(i)
            elif self.id_of_byte:
                out.extend(self.id_of_byte[b] for b in text[-1 - i].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def _unit(self, rest: str) -> tuple[bytes, str]:
        unit = SPACE + rest
        if not self.by_line or "\n" not in unit:
            raw = self._ids(unit)
        else:
            raw = b"".join([self.segments[x] for x in re.split("(\n)", unit) if x])
        return raw, self._text(raw)

    def _units(self, text: str) -> list[tuple[bytes, str]]:
        """Ids of a text and what they give back, unit by unit."""
        if not text:
            return []
        body = text.replace(" ", SPACE)
        if not self.by_space or not self.prefix or not self.id_of_byte:
            raw = self._ids(SPACE + body if self.prefix else body)
            return [(raw, self._text(raw))]
        rests = body.split(SPACE)
        if "" in rests:  # runs of spaces stay together
            rests = [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + body)]
        return [self.units[x] for x in rests]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, with begin and end."""
        raw = b"".join([x for x, _ in self._units(text or "")])
        return [self.begin, *struct.unpack(f"<{len(raw) // 4}I", raw), self.end]

    def _text(self, raw: bytes) -> str:
        """Text of ids, the space mark of the beginning included."""
        ids = struct.unpack(f"<{len(raw) // 4}I", raw)
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:  # a control, unknown or byte id
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_from_bytes(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_from_bytes(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids are silent, runs of byte ids become characters, the first space mark goes."""
        text = self._text(struct.pack(f"<{len(ids)}I", *ids))
        first = next((i for i in ids if i not in self.silent), None)
        marked = first is not None and self.prefix and first not in self.byte_of and self.pieces[first].startswith(SPACE)
        return text[1:] if marked else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of all ids, hash of the ids, hash of the text that the ids give back."""
        units = self._units(text or "")
        raw = b"".join([self.edge[0], *[x for x, _ in units], self.edge[1]])
        if self.by_space and self.prefix and self.id_of_byte:
            back = "".join([x for _, x in units])[1:]  # every unit begins with a space mark, so no run of bytes crosses units
        else:
            back = self.decode(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


class _Memo(dict):
    """Results by argument. When it is full, the entries step back by one generation, and those not asked for since then go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict = {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _from_bytes(raw: bytes) -> str:
    """UTF-8 text; a byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


def codec(model: bytes, remembered: int = REMEMBERED) -> Codec:
    """The codec of a model file, built once per Python process."""
    key = f"{hashlib.sha256(model).hexdigest()} {remembered}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(model, remembered)
    return _LOADED[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, text: str, model_path: str, ids: str = "ids") -> DataFrame:
    """All rows and columns with the ids of `text` (null: as empty) as an array; a column called `ids` must not exist."""
    if fresh(df, ids) != ids:
        raise ValueError(f"column {ids} exists")
    model = _shared(df.sparkSession, model_path)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            rows = [own.encode(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], [*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str, model_path: str, text: str = "decoded") -> DataFrame:
    """All rows and columns with the text of the ids (null: null)."""
    if fresh(df, text) != text:
        raise ValueError(f"column {text} exists")
    model = _shared(df.sparkSession, model_path)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            rows = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def digest_texts(df: DataFrame, key: str, text: str, model_path: str, remembered: int = REMEMBERED) -> DataFrame:
    """One row per row: `key`, n_tokens, ids_sha256, decoded_sha256."""
    model = _shared(df.sparkSession, model_path)
    kept = df.select(key, text)
    schema = T.StructType([kept.schema[key], *T._parse_datatype_string("n_tokens bigint, ids_sha256 string, decoded_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, remembered)
        for batch in batches:
            rows = [own.digest(x) for x in batch.column(1).to_pylist()]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema.fieldNames())

    return kept.mapInArrow(run, schema)


def _shared(spark: SparkSession, model_path: str):
    """The model file, half a megabyte whatever the data, sent to every executor once."""
    ship(spark)
    return spark.sparkContext.broadcast(_model(model_path))
