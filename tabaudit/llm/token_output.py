"""Token-id files: flat unsigned integers and 64-bit document offsets, memory-mapped.

One logical sequence of ids, in ascending order of the document id, is kept
in as many part files as there are range partitions:

* ``ids-<part>.bin``: ids, little endian, 16 bits wide if the vocabulary fits, else 32;
* ``offsets-<part>.bin``: ``documents + 1`` offsets into the part, unsigned 64 bits;
* ``documents-<part>.bin``: 9 bytes per document, signed 64-bit id and 1 if it is known (0: null);
* ``manifest``: a Parquet table with documents and ids per part.

A part begins, in the whole sequence, where the prefix sum over the parts
before it ends, so no task waits for another.

Defined cases: a null text is empty and holds the end id only; null document
ids come first; equal document ids are ordered by a hash of the text, so equal
rows are written once each; no document gives no part file and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabaudit.llm.common import col, open_store, publish, shared_folder, slices

#: Bounded memory of the encoder: bytes of what it remembers, bytes of a word worth remembering, and bytes of text per call.
MEMO_BYTES = 64 << 20
#: Share of the memory that words keep when some are forgotten.
KEPT = 0.6
LONGEST_WORD = 256
SLICE_BYTES = 4 << 20
#: Bytes of a remembered word beside its characters (held twice while words are looked up) and ids: places in the arrays and the lookup.
_ENTRY = 72
MANIFEST = "part int, n_documents long, n_tokens long, width int"
_DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1")])


class PieceEncoder:
    """Encodes with a byte-level BPE of the tokenizers library, distinct words once.

    A border always lies before a blank or line feed that stands between two
    printing characters, and no merge crosses it; so a text of such words has
    the ids of its words, and words repeat. A text with any other white space,
    with control characters, with a very long word or with a special token is
    encoded whole; so is every text if the file describes another tokenizer.

    Words are remembered as they follow a blank, with their line feed, or with
    a zero character where they begin the text; ``words`` holds them as one
    Arrow array, ``pool`` their ids one after the other, ``at`` where each
    begins, ``uses`` how often each was met.
    Where all that takes more than ``MEMO_BYTES``, the words used most stay, in
    the share ``KEPT`` of it.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = f"<u{width}"
        described = json.loads(self.tokenizer.to_str())
        splitter = described.get("pre_tokenizer") or {}
        #: Whether borders lie before single blanks, as the encoder needs.
        self.pieces = (
            described["model"].get("type") == "BPE" and not described.get("normalizer") and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex") is True and splitter.get("add_prefix_space") is False and not described["model"].get("dropout")
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        #: Bytes of each token: a character of its byte alphabet stands for one.
        self.n_bytes = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, at in tokens.items():
            self.n_bytes[at] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.pool, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.uses, self.size = np.zeros(0, np.int32), 0

    @property
    def known(self) -> set[str]:
        """The remembered words."""
        return set(self.words.to_pylist())

    def _sizes(self, first: int = 0) -> np.ndarray:
        """Bytes that each word takes, from the word numbered ``first`` on."""
        return 2 * pc.binary_length(self.words[first:]).to_numpy(zero_copy_only=False) + np.diff(self.at[first:]) * self.pool.itemsize + _ENTRY

    def _keep_most_used(self, limit: int) -> None:
        """Forget all words but those used most, as many as ``limit`` bytes hold; what is kept ages."""
        sizes, by_use = self._sizes(), np.argsort(-self.uses, kind="stable")
        kept = np.sort(by_use[np.cumsum(sizes[by_use]) <= limit])
        self.words = self.words.take(pa.array(kept))
        n = np.diff(self.at)[kept]
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.at[kept] - ends + n, n) + np.arange(n.sum())]
        self.at = np.r_[0, ends]
        self.uses = self.uses[kept] // 2
        self.size = int(sizes[kept].sum())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: pa.Array) -> None:
        """Encode joined words, some thousands at once, and part the ids by their bytes."""
        pools, ends, held = [self.pool], [self.at], len(self.pool)
        first = pc.starts_with(words, "\0")
        tail = pc.utf8_slice_codeunits(words, 1)
        spelled = pc.if_else(first, pc.binary_join_element_wise("\n", tail, ""), pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(" ", words, "")))
        sizes, first = pc.binary_length(spelled).to_numpy(zero_copy_only=False), first.to_numpy(zero_copy_only=False)
        for begin in range(0, len(words), 5000):
            own = slice(begin, begin + 5000)
            ids = self.whole("".join(spelled[own].to_pylist()))
            marks = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes[own], dtype=np.int64)) + 1
            if first[own].any():  # the line feed before it stood for the start of the text
                keep = np.ones(len(ids), bool)
                keep[np.r_[0, marks[:-1]][first[own]]] = False
                ids, marks = ids[keep], marks - np.cumsum(first[own])
            pools.append(ids)
            ends.append(marks + held)
            held += len(ids)
        first_new = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.pool, self.at = np.concatenate(pools), np.concatenate(ends)
        self.uses = np.r_[self.uses, np.zeros(len(words), np.int32)]
        self.size += int(self._sizes(first_new).sum())

    def _places(self, words: pa.Array) -> np.ndarray:
        """The number of each distinct word, learned where it is new."""
        if self.size > MEMO_BYTES:
            self._keep_most_used(int(MEMO_BYTES * KEPT))
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        missing = found < 0
        if missing.any():
            places, found = len(self.words), found.copy()
            self._learn(words.filter(pa.array(missing)))
            found[missing] = np.arange(places, len(self.words))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.pieces:
            coded = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.kind), *coded]), np.array([len(c) for c in coded], np.int64)
        flat = pc.replace_substring(texts, "\n", " ")
        plain = pc.and_(pc.utf8_is_printable(flat), pc.invert(pc.match_substring(flat, "  ")))
        for test in (pc.equal(flat, ""), pc.starts_with(flat, " "), pc.ends_with(flat, " "), *(pc.match_substring(flat, t) for t in self.special)):
            plain = pc.and_not(plain, test)
        split = lambda plain: pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\0", texts.filter(plain), ""), "\n", " \n"), " ")
        words = split(plain)
        long = pc.greater(pc.binary_length(words.flatten()), LONGEST_WORD).to_numpy(zero_copy_only=False)
        if long.any():
            sizes = np.diff(words.offsets.to_numpy())
            held = plain.to_numpy(zero_copy_only=False).copy()
            held[np.flatnonzero(held)[np.repeat(np.arange(len(sizes)), sizes)[long]]] = False
            plain = pa.array(held)
            words = split(plain)
        coded = words.flatten().dictionary_encode()
        places = self._places(coded.dictionary.cast(pa.string()))
        sizes = np.diff(self.at)[places]
        which = coded.indices.to_numpy(zero_copy_only=False)
        self.uses[places] += np.bincount(which, minlength=len(places)).astype(np.int32)
        n = sizes[which]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[places][which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.r_[0, ends][words.offsets.to_numpy() - words.offsets[0].as_py()] if len(words) else np.zeros(1, np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(borders)
        if plain.all():
            return ids, counts
        parts, own = [], iter(np.split(ids, borders[1:-1]) if len(words) else [])
        for i, p in enumerate(plain):
            parts.append(next(own) if p else self.whole(texts[i].as_py()))
            counts[i] = len(parts[-1])
        return np.concatenate(parts), counts


def _encoder(path: str, width: int) -> PieceEncoder:
    """One per Python worker, kept with the library: what it has learned serves the next task too."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_piece_encoders", {})
    if (path, width) not in kept:
        kept[path, width] = PieceEncoder(path, width)
    return kept[path, width]


@dataclass(frozen=True)
class TokenFiles:
    """A written sequence."""

    folder: str
    manifest: DataFrame


def _write_part(folder: str, path: str, end_id: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        names = {kind: (f"{root}/{kind}-{part:06d}.bin", f"{root}/.{kind}-{part:06d}-{uuid.uuid4().hex}") for kind in ("ids", "offsets", "documents")}
        out, count, tokens = {}, 0, 0
        encoder = None
        for batch in slices(batches, "text", SLICE_BYTES):
            if encoder is None:
                encoder = _encoder(path, width)
                store.create_dir(root, recursive=True)
                out = {kind: store.open_output_stream(temporary) for kind, (_, temporary) in names.items()}
                out["offsets"].write(np.zeros(1, "<u8").tobytes())
            encoded, lengths = encoder.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            out["ids"].write(np.insert(encoded, ends, end_id).tobytes())
            out["offsets"].write((ends + np.arange(1, len(ends) + 1) + tokens).astype("<u8").tobytes())
            ids = batch.column("id")
            documents = np.zeros(len(ids), _DOCUMENT)
            documents["id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            documents["known"] = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            out["documents"].write(documents.tobytes())
            count, tokens = count + len(ids), tokens + len(encoded) + len(ids)
        for kind, stream in out.items():
            stream.close()
            publish(store, names[kind][1], names[kind][0])
        if count:
            yield pa.RecordBatch.from_pylist([{"part": part, "n_documents": count, "n_tokens": tokens, "width": width}], pa.schema([("part", pa.int32()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return write


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0) -> TokenFiles:
    """Encode all documents and write the sequence below ``folder``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(_write_part(folder, tokenizer, end_id, width), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_token_files(spark, folder)


def open_token_files(spark: SparkSession, folder: str) -> TokenFiles:
    return TokenFiles(folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))


def _mapped(store: pyarrow.fs.FileSystem, path: str, kind: np.dtype | str) -> np.ndarray:
    """A file as array: mapped into memory where it is local, else read."""
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(files: TokenFiles, tell: Callable[[np.ndarray], int] | None = None, block: int = 20_000) -> DataFrame:
    """Per document of the files: id, start in the whole sequence, length, checksum of its ids.

    The bases of the parts are prefix sums over the manifest, which has a row
    per written part.
    """
    folder = files.folder
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = files.manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            ids = _mapped(store, f"{root}/ids-{row['part']:06d}.bin", f"<u{row['width']}")
            offsets = _mapped(store, f"{root}/offsets-{row['part']:06d}.bin", "<u8")
            documents = _mapped(store, f"{root}/documents-{row['part']:06d}.bin", _DOCUMENT)
            if not len(offsets) == len(documents) + 1 == row["n_documents"] + 1 or int(offsets[-1]) != len(ids):
                raise ValueError(f"part {row['part']} of {folder} is incomplete")
            for at in range(0, len(documents), block):
                own, marks = documents[at : at + block], offsets[at : at + block + 1].astype(np.int64)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(marks[:-1], marks[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own["id"].astype(np.int64), mask=own["known"] == 0),
                        pa.array(marks[:-1] + row["base"]),
                        pa.array(np.diff(marks)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a task for each part: their sizes say nothing of the work
    return bases.repartition(max(1, files.manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
