"""SentencePiece encoding and decoding, and distinct sampled segmentations by Gumbel top-k.

A text's segmentations are the paths of its piece lattice. A path's Gumbel-perturbed log-probability is drawn top-down:
the best of a set of paths is a plain sample of it, and the rest splits, edge by edge of that path, into sets whose
perturbed maxima are Gumbels cut off at the known maximum. A-star search opens the set of the highest bound until k
distinct paths are out; the next bound is the threshold of the inclusion scores. Random numbers come from a hash of the
row key, the sample and the place in the text, so a row's samples don't depend on partitions or neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marea.llm import common as C
from marea.llm.windows import slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Log-probability of a byte that stands for a part of an unknown character.
BYTE_LOG_PROB = -16.0
#: Bytes of text whose lattices and paths are held at once.
SLICE = 1 << 20
SAMPLE = "sample int, log_prob double, bound double, inclusion double, ids array<int>, round_trip boolean"


@dataclass
class Vocabulary:
    """Pieces as bytes (space for the word mark), their log-probabilities, and sorted prefix tables by length."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    log_probs: np.ndarray
    prefixes: list[tuple[np.ndarray, np.ndarray]]
    data: np.ndarray
    begin: np.ndarray

    def __post_init__(self):
        self.tables = [Table(*p) for p in self.prefixes]


class Table:
    """Prefixes of one length by hash: a slot holds one key, and keys that found theirs taken stand in a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slot = self.slot(keys)
        _, first = np.unique(slot, return_index=True)
        rest = np.ones(len(keys), bool)
        rest[first] = False
        size = 1 << int(64 - self.shift)
        self.keys, self.values, self.full = np.zeros(size, np.uint64), np.full(size, -2, np.int32), np.zeros(size, bool)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        self.full[slot[rest]] = True
        self.rest, self.rest_values = keys[rest], values[rest].astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD1342543DE82EF95)) >> self.shift).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -2 where there is none."""
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], np.int32(-2))
        more = np.flatnonzero((out == -2) & self.full[slot])
        if len(more):
            at = np.minimum(np.searchsorted(self.rest, keys[more]), len(self.rest) - 1)
            out[more] = np.where(self.rest[at] == keys[more], self.rest_values[at], np.int32(-2))
        return out


def load(path: str = DEFAULT_MODEL, shift: float = 10.0) -> Vocabulary:
    """A model's pieces. BPE scores are ranks: a piece of rank r gets a log-probability of -log(r + shift), by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, byte_ids, ranks, usable = [], np.full(256, -1, np.int64), np.zeros(n), np.zeros(n, bool)
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            pieces.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(model.id_to_piece(i).replace("▁", " ").encode())
            ranks[i], usable[i] = -model.get_score(i), True
    # runs of the word mark carry no rank; they count as the least frequent piece
    ranks[usable & (ranks > n)] = n
    tables: list[dict[int, int]] = [{} for _ in range(max(map(len, pieces)) + 1)]
    for i in np.flatnonzero(usable):
        key = 0
        for length, b in enumerate(pieces[i], 1):
            key = (key * 0x9E3779B97F4A7C15 + b + 1) % 2**64
            tables[length].setdefault(key, -1)
        tables[len(pieces[i])][key] = int(i)
    prefixes = []
    for t in tables[1:]:
        keys = np.array(sorted(t), dtype=np.uint64)
        prefixes.append((keys, np.array([t[int(k)] for k in keys], dtype=np.int64)))
    size = np.array([len(p) for p in pieces])
    return Vocabulary(pieces, byte_ids, np.where(usable, -np.log(np.maximum(ranks, 0) + shift), BYTE_LOG_PROB), prefixes, np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum(size)))


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a sequence of pieces, without the mark that stands before its first word."""
    size = np.diff(vocabulary.begin)[ids]
    out = np.append(0, np.cumsum(size))
    data = vocabulary.data[np.repeat(vocabulary.begin[ids] - out[:-1], size) + np.arange(out[-1])]
    return data[data[:1] == 32 and 1 or 0 :].tobytes() if len(data) else b""


class Lattice:
    """The lattices of distinct chunks, side by side: edges by start node, with their probabilities among paths."""

    def __init__(self, chunks: pa.Array, vocabulary: Vocabulary, theta: float = 1.0):
        raw, offsets = C.flat(chunks)
        n = len(raw)
        self.offsets = offsets
        stop = np.repeat(offsets[1:], np.diff(offsets)).astype(np.int32)  # end of each byte's chunk
        room = stop - np.arange(n, dtype=np.int32)
        live, key = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        starts, sizes, ids = [], [], []
        for length, table in enumerate(vocabulary.tables, 1):
            fits = room[live] >= length
            live, key = live[fits], key[fits]
            if not len(live):
                break
            key = key * np.uint64(0x9E3779B97F4A7C15) + raw[live + length - 1] + np.uint64(1)
            found = table.look(key)
            known = found > -2
            live, key, found = live[known], key[known], found[known]
            whole = found >= 0
            starts.append(live[whole].astype(np.int32))
            sizes.append(np.full(whole.sum(), length, np.int32))
            ids.append(found[whole].astype(np.int32))
        start, size, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, sizes, ids))
        # characters that are no piece go by their bytes
        first = (raw & 0xC0) != 0x80
        char = np.flatnonzero(first)
        width = np.diff(np.append(char, n))
        single = np.zeros(n, bool)
        wide = np.zeros(n + 1, np.int64)
        wide[char] = width
        single[start[size == wide[start]]] = True
        lone = ~single[char]
        inside = np.repeat(char[lone], width[lone]) + np.arange(width[lone].sum()) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone]) if lone.any() else np.zeros(0, np.int64)
        start = np.concatenate([start, inside]).astype(np.int32)
        size = np.concatenate([size, np.ones(len(inside), np.int32)])
        piece = np.concatenate([piece, vocabulary.byte_ids[raw[inside]]]).astype(np.int32)
        # by start, the longest first: presorted runs, one a length
        start, size, piece = start[::-1], size[::-1], piece[::-1]
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.piece = start[order], start[order] + size[order], piece[order]
        weight = theta * vocabulary.log_probs[self.piece]
        # sums over all paths to a chunk's end, from its end backwards; a chunk's end has sum 1, kept in the last place
        beta = np.full(n + 2, -np.inf)
        beta[n + 1] = 0.0
        goal = np.where(self.end == stop[self.start], np.int32(n + 1), self.end) if n else self.end
        left = room[self.start]
        level = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        # level by level, and in a level node by node
        far, node, to, add = left[level], self.start[level], goal[level], weight[level]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.append(True, far[1:] != far[:-1])) if len(far) else np.zeros(0, np.int64)
        heads, node = np.append(np.searchsorted(head, cuts), len(head)), node[head]
        for a, b, x, y in zip(cuts, np.append(cuts, len(level))[1:], heads[:-1], heads[1:], strict=False):
            beta[node[x:y]] = np.logaddexp.reduceat(add[a:b] + beta[to[a:b]], head[x:y] - a)
        to = beta[goal]
        # an edge that leads nowhere has no part in any path
        good = np.isfinite(to)
        if not good.all():
            self.start, self.end, self.piece, weight, to = self.start[good], self.end[good], self.piece[good], weight[good], to[good]
        log_q = np.minimum(weight + to - beta[self.start], 0.0)
        # with each edge the probability of its node's edges up to it
        self.log_q = log_q
        self.first = np.append(0, np.cumsum(np.bincount(self.start, minlength=n)))
        sums = np.cumsum(np.exp(self.log_q))
        last = np.zeros(len(sums), dtype=bool)
        last[self.first[1:][np.diff(self.first) > 0] - 1] = True
        self.upto = sums - np.append(0, sums)[self.first[self.start]]
        self.upto[last] = 2.0  # rounding must not lead beyond a node's last edge

    def walk(self, node: np.ndarray, stop: np.ndarray, draw: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Samples a path from each node to its stop; draw(lanes, nodes) gives uniforms. Lanes and edges, path by path."""
        lanes, edges = [], []
        live = np.flatnonzero(node < stop)
        at = node.copy()
        while len(live):
            here = at[live]
            e, u = self.first[here], draw(live, here)
            more = np.flatnonzero(u >= self.upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.upto[e[more]]]
            lanes.append(live)
            edges.append(e)
            at[live] = self.end[e]
            live = live[at[live] < stop[live]]
        if not lanes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane, edge = np.concatenate(lanes), np.concatenate(edges)
        order = np.argsort(lane, kind="stable")
        return lane[order], edge[order]


def _chunks(column):
    """Distinct chunks of the marked texts, code and place of each chunk, and each row's first chunk.

    A chunk is a run of marks with the characters up to the next mark, or a line feed: no piece crosses its borders.
    """
    raw, offsets = C.flat(column)
    size = np.diff(offsets)
    full = size > 0
    new = offsets + np.append(0, np.cumsum(full))
    text = np.full(new[-1], 32, np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.cumsum(full), size)] = raw
    cut = np.zeros(len(text) + 1, bool)
    cut[1:-1] = ((text[1:] == 32) & (text[:-1] != 32)) | (text[1:] == 10) | (text[:-1] == 10)
    cut[new] = True
    place = np.flatnonzero(cut)
    tokens = pa.Array.from_buffers(pa.large_binary(), max(0, len(place) - 1), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode() if len(text) else pa.array([], pa.large_binary()).dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy(), place[:-1], np.searchsorted(place, new), new, text


def _seeds(key: np.ndarray, what: int) -> np.ndarray:
    """Hash of key and purpose."""
    return C.mix(key + np.array([(what + 1) * 0x9E3779B97F4A7C15 % 2**64], dtype=np.uint64))


def _uniform(seeds: np.ndarray, place) -> np.ndarray:
    """Hash of a seed and a place, in (0, 1)."""
    x = C.mix(seeds + np.asarray(place).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def sample_slice(column, keys: np.ndarray, vocabulary: Vocabulary, k: int, seed: int = 0, theta: float = 1.0) -> list[list[dict]]:
    """The samples of each text, by falling perturbed log-probability; fewer than k where there are fewer segmentations."""
    distinct, code, place, first, begin, text = _chunks(column)
    lattice = Lattice(distinct, vocabulary, theta)
    chunk = lattice.offsets[code]  # first node of each chunk's lattice
    stop = lattice.offsets[code + 1]
    keys = C.mix(keys.view(np.uint64) + np.uint64(seed) * np.uint64(0x2545F4914F6CDD1D))
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    base = place - begin[rows]  # place of a chunk in its row
    shift = base - chunk  # from node to place in the row

    def walk(chunks, nodes, turn):
        seeds, away = _seeds(keys, 4 * turn)[rows[chunks]], shift[chunks]
        draw = lambda lanes, here: _uniform(seeds[lanes], here + away[lanes])
        lane, edge = lattice.walk(nodes, stop[chunks], draw)
        return chunks[lane], edge

    def branches(found, turn, margin=25.0):
        """Bounds of the sets that leave each path at each edge from `since` on, all paths of (row, path) side by side.

        path: edges, chunks, log-probabilities up to each edge from `since` on (sums), its own bound (top), and the edges
        excluded at `since` besides its own (banned). A set's bound is its log mass and 37 at most (uniforms have 52 bits),
        so sets far below the best are left out; `cut` bounds what is left out.
        """
        if not found:
            return
        for _, p in found:
            before = p["sums"][:-1]
            p["keep"] = keep = len(before) if margin is None else len(before) - int(np.searchsorted(before[::-1], min(before[0], p["top"]) - margin - 37.0, side="right"))
            p["cut"] = before[keep] + 37.0 if keep < len(before) else -np.inf
        kept = np.array([p["keep"] for _, p in found])
        at = np.append(0, np.cumsum(kept))
        take = lambda name: np.concatenate([p[name][p["since"] : p["since"] + p["keep"]] for _, p in found])
        edges, chunks = take("edge"), take("chunk")
        node = lattice.start[edges]
        away = np.log(np.maximum(-np.expm1(lattice.log_q[edges]), 1e-300))
        away[lattice.first[node + 1] - lattice.first[node] == 1] = -np.inf
        for (_, p), i in zip(found, at[:-1], strict=True):
            if p["banned"]:
                out = {*p["banned"], edges[i]}
                rest = [e for e in range(lattice.first[node[i]], lattice.first[node[i] + 1]) if e not in out]
                away[i] = np.log(max(np.exp(lattice.log_q[rest]).sum(), 1e-300)) if rest else -np.inf
        mass = np.concatenate([p["sums"][: p["keep"]] for _, p in found]) + away
        wait = -np.log(_uniform(np.repeat(_seeds(keys[[row for row, _ in found]], 4 * turn + 1), kept), shift[chunks] + node))
        with np.errstate(divide="ignore", over="ignore"):
            bound = mass - np.log(np.exp(mass - np.repeat([p["top"] for _, p in found], kept)) + wait)
        bound = np.where(np.isfinite(mass), bound, -np.inf)
        for (_, p), x, y in zip(found, at[:-1], at[1:], strict=True):
            p["bound"] = bound[x:y]
            p["bound"][p["used"]] = -np.inf

    paths: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    roots = -np.log(-np.log(_uniform(_seeds(keys, 2), 0)))
    chunks, edges = walk(np.arange(len(code)), chunk.copy(), 0)
    log_q = lattice.log_q[edges]
    cut = np.searchsorted(rows[chunks], np.arange(len(first))) if len(chunks) else np.zeros(len(first), int)
    for row in range(len(first) - 1):
        if cut[row + 1] > cut[row]:
            own = slice(cut[row], cut[row + 1])
            paths[row].append({"chunk": chunks[own], "edge": edges[own], "sums": np.append(0.0, np.cumsum(log_q[own])), "since": 0, "turn": 0, "top": float(roots[row]), "banned": [], "used": []})
    branches([(row, own[0]) for row, own in enumerate(paths) if own], 0)

    def best(row):
        while True:
            top, which = -np.inf, None
            for i, p in enumerate(paths[row]):
                if len(p["bound"]) and p["bound"][j := int(p["bound"].argmax())] > top:
                    top, which = float(p["bound"][j]), (i, j)
            short = [p for p in paths[row] if p["cut"] > top]
            if not short:
                return top, which
            for p in short:
                branches([(row, p)], p["turn"], None)

    for turn in range(1, k):
        picks = _uniform(_seeds(keys, 4 * turn + 3), 0)
        opened, todo_chunks, todo_nodes = [], [], []
        for row in range(len(paths)):
            top, which = best(row)
            if which is None or not np.isfinite(top):
                continue
            parent, at = paths[row][which[0]], which[1] + paths[row][which[0]]["since"]
            parent["used"].append(which[1])  # the set passes to the new path
            parent["bound"][which[1]] = -np.inf
            own = parent["edge"][at]
            banned = [own, *(parent["banned"] if which[1] == 0 else [])]
            node, c = lattice.start[own], parent["chunk"][at]
            others = np.array([e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in banned])
            p = np.cumsum(np.exp(lattice.log_q[others] - lattice.log_q[others].max()))
            new = others[min(int(np.searchsorted(p, picks[row] * p[-1])), len(others) - 1)]
            opened.append((row, parent, at, new, banned, top))
            todo_chunks.append(np.arange(c, first[row + 1]))
            nodes = chunk[c : first[row + 1]].copy()
            nodes[0] = lattice.end[new]
            todo_nodes.append(nodes)
        if not opened:
            break
        chunks, edges = walk(np.concatenate(todo_chunks), np.concatenate(todo_nodes), turn)
        log_q, new_paths = lattice.log_q[edges], []
        cut = np.searchsorted(rows[chunks], np.arange(len(first)))
        for row, parent, at, new, banned, top in opened:
            a, b = cut[row], cut[row + 1]
            sums = np.cumsum(np.concatenate([[parent["sums"][at - parent["since"]], lattice.log_q[new]], log_q[a:b]]))
            path = {"chunk": np.concatenate([parent["chunk"][: at + 1], chunks[a:b]]), "edge": np.concatenate([parent["edge"][:at], [new], edges[a:b]]), "sums": sums, "since": at, "turn": turn, "top": top, "banned": banned, "used": []}
            paths[row].append(path)
            new_paths.append((row, path))
        branches(new_paths, turn)
    out, flat = [], []
    for row, own in enumerate(paths):
        limit, _ = best(row)
        told = []
        for i, p in enumerate(own):
            score = 1.0 if not np.isfinite(limit) else float(-np.expm1(-np.exp(min(p["sums"][-1] - limit, 700.0))))
            told.append({"sample": i, "log_prob": float(p["sums"][-1]), "bound": float(p["top"]), "inclusion": score, "ids": lattice.piece[p["edge"]]})
        out.append(told)
        flat += [(row, t) for t in told]
    if flat:  # all samples are decoded side by side
        ids = np.concatenate([t["ids"] for _, t in flat])
        size = np.diff(vocabulary.begin)[ids]
        upto = np.append(0, np.cumsum(size))
        back = vocabulary.data[np.repeat(vocabulary.begin[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cut, marked = upto[np.append(0, np.cumsum([len(t["ids"]) for _, t in flat]))], text.tobytes()
        for (row, t), x, y in zip(flat, cut[:-1], cut[1:], strict=True):
            t["round_trip"] = back[x:y] == marked[begin[row] : begin[row + 1]]
    return out


def sample(docs: DataFrame, key: str = "doc_id", k: int = 3, seed: int = 0, theta: float = 1.0, model: str = DEFAULT_MODEL, held_bytes: int = SLICE) -> DataFrame:
    """doc_id and the samples of each text (SAMPLE), one row a sample; texts that are null or empty have none.

    ids: the pieces; bound: the perturbed log-probability, falling; inclusion: the probability that the path is among
    the first k given the threshold, 1 where all segmentations are out; round_trip: decoding gave the text back. Rows
    of one key and text have the same samples; a null key counts as 0. theta scales the log-probabilities.
    """
    C.lean(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=held_bytes):
                keys = part.column("key").fill_null(0).to_numpy().astype(np.int64)
                found = sample_slice(part.column("text"), keys, held.value, k, seed, theta)
                n = [len(x) for x in found]
                flat = [s for x in found for s in x]
                if not flat:
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s["ids"]) for s in flat])).astype(np.int32)), pa.array(np.concatenate([s["ids"] for s in flat]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([s["sample"] for s in flat], pa.int32()), *(pa.array([s[c] for s in flat], pa.float64()) for c in ("log_prob", "bound", "inclusion")), lists, pa.array([s["round_trip"] for s in flat])], ["doc_id", *(c.split()[0] for c in SAMPLE.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(key).cast("long").alias("key"), "text").mapInArrow(C.tidy(run), f"doc_id {kind}, {SAMPLE}")


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text and ids: the model's own segmentation; null texts have null ids."""

    def run(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                ids = [None if t is None else processor.encode(t, num_threads=1) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(C.tidy(run), "doc_id long, text string, ids array<int>")


def decode(df: DataFrame, ids: Column | str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and the text of a column of pieces; null stays null, bytes that are no UTF-8 become U+FFFD."""
    held = df.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        for batch in batches:
            out = [None if x is None else decode_ids(held.value, np.array(x, np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", F.col(ids).alias("ids") if isinstance(ids, str) else ids.alias("ids")).mapInArrow(C.tidy(run), "doc_id long, text string")


def digest(docs: DataFrame, k: int = 3, held_bytes: int = SLICE) -> DataFrame:
    """One row a sample: its number, pieces, scores, a hash of its ids, and whether it decodes to the text."""
    return sample(docs, k=k, held_bytes=held_bytes).select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.round("log_prob", 6).alias("log_prob"), F.round("bound", 6).alias("bound"), F.round("inclusion", 6).alias("inclusion"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
