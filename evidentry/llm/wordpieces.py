"""SentencePiece encoding and decoding by a table of distinct marked words, exact to the id.

The library writes every blank as the marker U+2581 and one more before the text. Where no piece
of the vocabulary has a marker after another character, no merge reaches over the place before a
run of markers, so a text's ids are those of its marked words end to end. The words of many
texts are cut at once, each distinct one is segmented by the library once, and the ids are joined
back by the words' positions. A model without that property (pieces over markers, a normalizer
that changes texts, markers as suffixes) has whole texts given to the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, islice

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import kept, pieces, unused

MARK = "▁"
#: A run of markers, and the other characters up to the next one.
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
#: Longer marked words are segmented once for each slice of a batch, and not kept.
KEPT_CHARS = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_stand_alone(model) -> bool:
    """True if no merge of this model can join a marked word with the one before it, and texts are segmented as they are."""
    norm, trainer = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
    if not plain or trainer.treat_whitespace_as_suffix or trainer.model_type != trainer.BPE:
        return False
    names = {p.piece for p in model.pieces}
    return MARK in names and not any(MARK in n.lstrip(MARK) for n in names)


class WordTable:
    """Ids of marked words as little-endian unsigned 32-bit integers; ``limit`` words, some 120 MB, are kept at most between slices."""

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        self.by_words = words_stand_alone(model)
        self.begin, self.end = (struct.pack("<I", i) for i in (self.library.bos_id(), self.library.eos_id()))
        self.table: dict[str, bytes] = {}
        self.limit = limit
        self.bytes_of = self._bytes_of_pieces()

    def _bytes_of_pieces(self) -> list[bytes | None]:
        """What each id adds to a decoded text; None where only the library knows."""
        lib, out = self.library, []
        for i in range(lib.get_piece_size()):
            if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                out.append(None)
            elif lib.is_byte(i):
                out.append(bytes([int(lib.id_to_piece(i)[3:-1], 16)]))
            else:
                out.append(lib.id_to_piece(i).replace(MARK, " ").encode())
        return out

    def _segmented(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self.library.encode(texts, out_type=int, num_threads=1)] if texts else []

    def _cut(self, text: str) -> list[str]:
        """The marked words, each without its first marker, which the library sets itself."""
        if "  " in text or MARK in text or text[:1] == " ":
            return [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids between the begin and end ids."""
        distinct = list(dict.fromkeys(texts))
        found: dict[str, bytes] = {}
        if not self.by_words:
            found.update(zip(distinct, self._segmented(distinct)))
        else:
            found[""] = b""  # the library sets no marker before an empty text
            if len(self.table) > self.limit:  # the words met first are the frequent ones
                self.table = dict(islice(self.table.items(), self.limit // 2))
            table, once = self.table, {}
            cut = [(t, self._cut(t)) for t in distinct if t]
            new = list(set().union(*(words for _, words in cut)).difference(table))
            if "" in new:  # a marker alone: the library would not set it before nothing
                table[""] = struct.pack("<I", self.library.piece_to_id(MARK))
                new.remove("")
            short = [len(w) <= KEPT_CHARS for w in new]
            kept = list(compress(new, short))
            table.update(zip(kept, self._segmented(kept)))
            long = [w for w, s in zip(new, short) if not s]
            once.update(zip(long, self._segmented(long)))
            for text, words in cut:
                try:
                    found[text] = b"".join(map(table.__getitem__, words))
                except KeyError:
                    found[text] = b"".join([table[w] if w in table else once[w] for w in words])
        return [self.begin + found[t] + self.end for t in texts]

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives for these ids."""
        values = memoryview(ids).cast("I").tolist()
        inner = values[1:-1] if ids[:4] == self.begin and ids[-4:] == self.end else values
        if not self.by_words or not inner or self.library.is_byte(inner[0]):
            return self.library.decode(values)
        try:
            text = b"".join([self.bytes_of[i] for i in inner]).decode()
        except (IndexError, TypeError, UnicodeDecodeError):  # ids of no text: unknown, control among others, bytes that are no UTF-8
            return self.library.decode(values)
        return text[1:] if text[:1] == " " else text


def word_table(path: str) -> WordTable:
    """The one that this Python worker keeps, so that its table outlives a task."""
    return kept(("word-table", path), lambda: WordTable(path))


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``ids``: all ids of the text, begin and end included, as little-endian unsigned 32-bit integers.

    One row for each row of ``docs``, repeated ones too, with all its other columns (a column
    named ids gives way to a name with underscores, as ``unused`` names it). Null texts count as
    empty and have the two ids alone; an empty table gives none. Texts of any length are taken
    whole, in slices of some 4 MB of texts, one text at least. ``path`` names the model's file
    on every machine.
    """
    path = path or default_path()
    (own,) = unused(docs, "ids")
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(path)
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("").to_pylist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.encode(texts), pa.binary())], [*others, own])

    plain = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`"))
    return plain.mapInArrow(run, plain.drop(text_col).withColumn(own, F.lit(b"")).schema)


def decoded(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids_col`` beside it, as the library's decode gives it; null ids give an empty text.

    The text's column is ``text``, or a name with underscores where ``rows`` has that column.
    An id that the model doesn't have fails the task with the library's error.
    """
    path = path or default_path()
    (own,) = unused(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(path)
        for batch in pieces(batches, ids_col):
            texts = [words.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, own])

    return rows.mapInArrow(run, rows.withColumn(own, F.lit("")).schema)
