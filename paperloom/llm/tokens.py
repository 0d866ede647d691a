"""Token ids of a whole corpus with a public byte-level BPE vocabulary, contracted by recursive SQL in DuckDB.

Each Spark task splits its texts into words with the vocabulary's pattern and gives the different words of a batch
to DuckDB as token-position rows. A recursive query joins neighbouring tokens to the merge table and, in each
step, contracts in every word the pair of least rank, leftmost first without overlap, until no pair is left; an
ordered aggregation gives the ids. Recursions are bounded, and long words go through several. No shuffle: one scan, one Arrow pass.

Defined results: a null text and an empty text give an empty list; strings of special tokens are ordinary text;
whole texts are encoded whatever their length; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# The same pattern in the standard library's terms, for texts of Latin letters and common signs only, where both agree.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_UNUSUAL = re.compile("[^\t\n\r -~\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u024f\u2010-\u2027\u2030-\u203a\u20ac]")
#: A batch of different words goes to DuckDB when it has so many letters, after the text that brings it there.
BATCH_LETTERS = 1_000_000
#: A task remembers the ids of so many words.
MEMORY = 400_000

#: Steps of one recursion; words that need more go on from where they are, so no recursion keeps many rounds.
ROUNDS = 64

# In a step, every word's pairs of least rank are contracted; where they overlap, as in a run of one token, every other one.
_STEP = f"""
WITH RECURSIVE st(it, w, pos, tok, done) AS (
  SELECT 0, w, pos, tok, false FROM base
  UNION ALL
  SELECT it + 1, w, pos, CASE WHEN take THEN merged ELSE tok END, least_rank IS NULL
  FROM (
    SELECT *, lag(take) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(rank = least_rank AND (tok <> nxt OR (rn - run_start) % 2 = 0), false) AS take
      FROM (
        SELECT n.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS least_rank,
               max(CASE WHEN prv IS DISTINCT FROM tok THEN rn END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run_start
        FROM (
          SELECT it, w, pos, tok, lead(tok) OVER o AS nxt, lag(tok) OVER o AS prv, row_number() OVER o AS rn
          FROM st WHERE NOT done AND it < {ROUNDS}
          WINDOW o AS (PARTITION BY w ORDER BY pos)
        ) n LEFT JOIN merges m ON n.tok = m.l AND n.nxt = m.r
      )
    )
  ) WHERE gone IS NOT TRUE
)
SELECT w, done, list(tok ORDER BY pos) AS ids FROM st WHERE done OR it = {ROUNDS} GROUP BY w, done
"""


class Encoder:
    """One DuckDB connection with the merge table, and the words seen so far."""

    def __init__(self, directory: str):
        import duckdb

        model = json.load(open(os.path.join(directory, VOCABULARY), encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], model["merges"]
        # the printable stand-ins of the 256 bytes: printable Latin-1 stays, the others follow from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(keep)]
        sign = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte_id = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '700MB'")
        self.con.execute("SET temp_directory = ''")  # batches are small; nothing may spill to a machine's own disk
        public = pa.table({"l": [vocab[a] for a, _ in pairs], "r": [vocab[b] for _, b in pairs], "rank": list(range(len(pairs))), "merged": [vocab[a + b] for a, b in pairs]})  # noqa: F841 DuckDB reads it by name
        self.con.execute("CREATE TABLE merges AS SELECT l::INTEGER AS l, r::INTEGER AS r, rank::INTEGER AS rank, merged::INTEGER AS merged FROM public")
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Contract the words; batches are bounded by bytes, or hold one word, however long."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tok = self.byte_id[np.frombuffer(b"".join(raws), np.uint8)]
        while len(w):
            base = pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok.astype(np.int32)})
            self.con.register("base", base)
            out = self.con.sql(_STEP).to_arrow_table()
            self.con.unregister("base")
            rest: list[tuple[int, list[int]]] = []
            for k, done, ids in zip(out.column("w").to_pylist(), out.column("done").to_pylist(), out.column("ids").to_pylist()):
                if done:
                    self.known[words[k]] = ids
                else:
                    rest.append((k, ids))
            w = np.repeat(np.array([k for k, _ in rest], np.int32), [len(x) for _, x in rest]) if rest else np.zeros(0, np.int32)
            pos = np.concatenate([np.arange(len(x)) for _, x in rest]) if rest else pos[:0]
            tok = np.array([i for _, x in rest for i in x], np.int32)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [(_FAST.findall(t) if _UNUSUAL.search(t) is None else PATTERN.findall(t)) if t else [] for t in texts]
        new: dict[str, None] = {}
        size = 0
        for words in split:
            for x in words:
                if x not in self.known and x not in new:
                    new[x] = None
                    size += len(x) + 1
            if size > BATCH_LETTERS:
                self.learn([*new])
                new, size = {}, 0
        if new:
            self.learn([*new])
        known = self.known
        return [[i for x in words for i in known[x]] for words in split]


_encoders: dict[str, Encoder] = {}


def encoder(directory: str) -> Encoder:
    if directory not in _encoders:
        _encoders[directory] = Encoder(directory)
    return _encoders[directory]


def encode_corpus(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids); see the module's text for the defined results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")
