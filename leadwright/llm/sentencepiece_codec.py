"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import text_groups, worker_state, written
from leadwright.llm.stretches import ROOM, StretchTable

MARK = "▁"
#: The key of a marker that stands in a text itself; no part of a text has a marker after another character.
OWN_MARK = "x▁"
#: What an unknown character costs below the least score, as in the unigram model.
UNKNOWN = 10.0
#: Rounds of expectation and maximisation, and what a piece counts at least.
EM_ROUNDS, LEAST = 2, 0.01
#: Expected counts of a part are rounded to a share of 1 / SCALE, so that their sums do not depend on the order.
SCALE = 1 << 20
#: Distinct stretches that a task counts before it hands them on; the table has room for twice as many.
COUNTED = 1 << 17
#: In a lattice, a character that no piece covers.
UNCOVERED = -2
#: Characters whose lattice is held at once, and those of the longest part that is cut with others.
LATTICE, TOGETHER = 1 << 16, 100


class DoubleArray:
    """A trie in two arrays: child c of state s is base[s] + c where check says s."""

    def __init__(self, words: dict[str, int]):
        chars = sorted({c for w in words for c in w})
        self.codes = {c: i + 1 for i, c in enumerate(chars)}
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, value in words.items():
            node = 0
            for c in word:
                code = self.codes[c]
                if code not in nodes[node]:
                    nodes[node][code] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                node = nodes[node][code]
            ends[node] = value
        size = len(nodes) + len(chars) + 2
        used = bytearray(2 * size + 2)
        used[0] = 1
        self.base, self.check, self.value = [0] * (2 * size), [-1] * (2 * size), [-1] * (2 * size)
        state, free = {0: 0}, 1
        for node, children in enumerate(nodes):
            at = state[node]
            self.value[at] = ends[node]
            if not children:
                continue
            codes = sorted(children)
            while used[free]:
                free += 1
            base = max(0, free - codes[0])
            while any(base + c < len(used) and used[base + c] for c in codes):
                base += 1
            if (top := base + codes[-1]) >= len(self.base):
                more = top + size - len(self.base)
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            if len(used) < len(self.base) + 2:
                used += bytearray(len(self.base) + 2 - len(used))
            self.base[at] = base
            for c in codes:
                used[base + c] = 1
                self.check[base + c] = at
                state[children[c]] = base + c
        self.length = len(self.base)


class Codec:
    """Encodes and decodes texts with the pieces of a SentencePiece model file and log probabilities of a unigram model.

    The file's own scores are negative merge ranks if it is a BPE model, so only their order is used: by default the piece
    of rank r has a probability in proportion to 1 / r; fit_scores estimates probabilities from texts. A text gets a space before it, spaces become the whitespace marker, and the segmentation with the highest sum of
    scores is chosen; of equal ones, that with the longest last piece. A character that no piece covers costs UNKNOWN
    below the least score and becomes its UTF-8 bytes' pieces; so does a marker that stands in the text itself, which
    makes decoding exact. No normalisation is done. An empty text has no ids.
    """

    def __init__(self, model_file: str, room: int = ROOM):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        words = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in words):
            raise ValueError("a piece has a marker after another character")
        self.vocabulary = np.array(sorted(words.values(), key=lambda i: (-model.get_score(i), i)))
        self.by_rank = np.zeros(n)
        self.by_rank[self.vocabulary] = -np.log(np.arange(1, len(words) + 1)) - np.log((1.0 / np.arange(1, len(words) + 1)).sum())
        self.trie = DoubleArray(words)
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[[ord(c) for c in self.trie.codes]] = list(self.trie.codes.values())
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.trie.base, self.trie.check, self.trie.value = (array("i", x.tolist()) for x in (self.base, self.check, self.value))  # for single steps
        self.longest = max(map(len, words))
        self.room = room
        self.use(self.by_rank)
        # No piece goes from another character to a marker, and none holds these: the best segmentation is that of the parts.
        alone = "".join(c for c in "\n\t\r\f\v" if c not in self.trie.codes)
        self.split = re.compile(f"[{re.escape(alone)}]|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        plain = [p.replace(MARK, " ").encode() if not special[i] else b"" for i, p in enumerate(self.pieces)]
        for i, b in self.bytes_of.items():
            plain[i] = bytes([b])
        self.plain = plain

    def use(self, scores: np.ndarray) -> None:
        """Take these log scores, one for each piece of the file."""
        self.scores = scores.tolist()
        self.unknown = float(scores[self.vocabulary].min()) - UNKNOWN
        self.table = StretchTable(self.stretch_ids, self.room)

    def _groups(self, parts: list[str], among: list[int]) -> Iterator[list[int]]:
        """Places of parts of about one length, as many as LATTICE characters hold, or one part."""
        sizes = np.array([len(parts[i]) for i in among])
        order, at = np.argsort(sizes, kind="stable"), 0
        sizes = sizes[order]
        while at < len(order):
            fits = (np.arange(1, len(order) - at + 1) * sizes[at:] <= LATTICE)[: LATTICE + 1]
            to = at + max(1, int(fits.sum()))  # n parts of the last one's size; that grows with n
            yield [among[i] for i in order[at:to]]
            at = to

    def _lattice(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts' sizes, and at [d - 1, i, a] the piece of d characters that part i has from character a on, or -1; UNCOVERED is a single character that no piece covers."""
        sizes = np.array([len(p) for p in parts])
        width = int(sizes.max())
        there = np.arange(width) < sizes[:, None]
        code = np.zeros((len(parts), width), np.int32)
        code[there] = self.code_of[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = code.ravel()
        piece = np.full((min(self.longest, width), len(parts) * width), -1, np.int32)
        at, state = np.flatnonzero(there), np.zeros(there.sum(), np.int32)
        ends = (np.arange(len(parts)) * width + sizes).repeat(sizes)
        for depth in range(len(piece)):
            c = code[at + depth]
            to = self.base[state] + c
            go = (c > 0) & (to < self.trie.length)
            go[go] = self.check[to[go]] == state[go]
            if depth == 0:
                single = np.zeros(len(code), bool)
                single[at[go]] = self.value[to[go]] >= 0
                piece[0, at[~single[at]]] = UNCOVERED
            at, state, ends = at[go], to[go], ends[go]
            hit = self.value[state] >= 0
            piece[depth, at[hit]] = self.value[state[hit]]
            inside = at + depth + 1 < ends
            at, state, ends = at[inside], state[inside], ends[inside]
            if not len(at):
                break
        return sizes, piece.reshape(len(piece), len(parts), width)

    def _weights(self, piece: np.ndarray) -> np.ndarray:
        """The log scores of the lattice, in which no piece has -inf and an uncovered character its cost."""
        scores = np.concatenate([self.scores, [self.unknown, -np.inf]])  # UNCOVERED is the last but one place, -1 the last
        return scores[piece]

    def expected(self, parts: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the parts under the scores, each part `times` over, in SCALE-ths: forward and backward sums over all segmentations."""
        total = np.zeros(len(self.pieces), np.int64)
        for some in self._groups(parts, [i for i, p in enumerate(parts) if p != OWN_MARK]):
            total += self._expected([parts[i] for i in some], times[some])
        return total

    def _expected(self, parts: list[str], times: np.ndarray) -> np.ndarray:
        sizes, piece = self._lattice(parts)
        weight = self._weights(piece)
        depth, n, width = weight.shape
        ahead, back = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        ahead[0] = 0.0

        def log_sum(terms: list[np.ndarray]) -> np.ndarray:
            top = np.maximum(np.max(terms, axis=0), -1e300)
            return top + np.log(np.sum([np.exp(t - top) for t in terms], axis=0), out=np.full(n, -np.inf), where=top > -1e300)

        for b in range(1, width + 1):
            ahead[b] = log_sum([ahead[b - d] + weight[d - 1, :, b - d] for d in range(1, min(depth, b) + 1)])
        for a in range(width, -1, -1):
            steps = [weight[d - 1, :, a] + back[a + d] for d in range(1, min(depth, width - a) + 1)]
            back[a] = np.where(sizes == a, 0.0, log_sum(steps) if steps else -np.inf)
        whole = ahead[sizes, np.arange(n)]
        out = np.zeros(len(self.pieces), np.int64)
        for d in range(1, depth + 1):
            i, a = np.nonzero(piece[d - 1] >= 0)
            chance = np.exp(ahead[a, i] + weight[d - 1, i, a] + back[a + d, i] - whole[i])
            np.add.at(out, piece[d - 1, i, a], np.rint(chance * SCALE).astype(np.int64) * times[i])
        return out

    def best_of(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part as bytes of int32. Viterbi over all parts of about one length together; long parts and those with an uncovered character each alone."""
        found = {OWN_MARK: np.array([self.byte_ids[x] for x in MARK.encode()], np.int32).tobytes()}
        alone = [i for i, p in enumerate(parts) if len(p) > TOGETHER and p != OWN_MARK]
        for some in self._groups(parts, [i for i, p in enumerate(parts) if len(p) <= TOGETHER and p != OWN_MARK]):
            group = [parts[i] for i in some]
            sizes, piece = self._lattice(group)
            weight = self._weights(piece)
            depth, n, width = weight.shape
            top, came = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int64)
            top[0] = 0.0
            for b in range(1, width + 1):
                for d in range(min(depth, b), 0, -1):  # of equal sums, the one with the longest last piece
                    sum_ = top[b - d] + weight[d - 1, :, b - d]
                    better = sum_ > top[b]
                    top[b][better] = sum_[better]
                    came[b][better] = d
            row, place, steps = np.arange(n), sizes.copy(), []
            while place.any():
                d = came[place, row]
                ids = np.where(place > 0, piece[d - 1, row, np.maximum(place - d, 0)], -1)
                place = np.maximum(place - d, 0)
                steps.append(ids)
            ids = np.stack(steps[::-1], 1)
            alone += [some[i] for i in np.flatnonzero((ids == UNCOVERED).any(1))]
            flat = ids[ids != -1].tobytes()
            ends = (4 * np.cumsum((ids != -1).sum(1))).tolist()
            found.update(zip(group, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        found.update((parts[i], np.array(self.best(parts[i]), np.int32).tobytes()) for i in alone)
        return found

    def best(self, word: str) -> tuple[int, ...]:
        """The ids of a part of a text, by Viterbi over its characters."""
        base, check, value, codes, scores, length = self.trie.base, self.trie.check, self.trie.value, self.trie.codes, self.scores, self.trie.length
        n = len(word)
        code = [codes.get(c, 0) for c in word]
        top: list[float] = [0.0] + [-float("inf")] * n
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for a in range(n):
            here = top[a]
            state = 0
            single = False
            for b in range(a, n):
                if not (c := code[b]):
                    break
                to = base[state] + c
                if to >= length or check[to] != state:
                    break
                state = to
                if (piece := value[to]) >= 0:
                    single = single or b == a
                    if (s := here + scores[piece]) > top[b + 1]:
                        top[b + 1] = s
                        came[b + 1] = a, piece
            if not single and (s := here + self.unknown) > top[a + 1]:
                top[a + 1] = s
                came[a + 1] = a, -1
        ids: list[int] = []
        while n:
            a, piece = came[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[x] for x in reversed(word[a:n].encode("utf-8", "surrogatepass"))]
            n = a
        return tuple(reversed(ids))

    def parts(self, text: str) -> list[str]:
        """What is encoded apart: a text after a space, its spaces as markers, cut before each run of markers and around what no piece holds. A marker of the text itself is OWN_MARK."""
        if MARK not in text:
            return self.split(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            out += [OWN_MARK] * (i > 0)
            out += self.split(("" if i else MARK) + part.replace(" ", MARK))
        return out

    def stretch_parts(self, stretches: list[bytes], head: list[bool]) -> list[list[str]]:
        return [self.parts(x.decode() if h else x[1:].decode()) for x, h in zip(stretches, head)]

    def stretch_ids(self, stretches: list[bytes], head: list[bool]) -> list[bytes]:
        split = self.stretch_parts(stretches, head)
        known = self.best_of(list(set().union(*split))).__getitem__
        return [known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for p in split]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; text i is data[offsets[i]:offsets[i + 1]] in UTF-8, and offsets begin at 0."""
        mark = self.table.mark()
        start, head = cut_at_spaces(data, offsets)
        flat, sizes = self.table.ids(self.table.entries(data, start, head))
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]
        self.table.forget(mark)
        return flat, np.diff(upto)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data = [t.encode() for t in texts]
        flat, sizes = self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        return np.split(flat, np.cumsum(sizes)[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8: byte pieces as they are, markers as spaces, without the space before the text."""
        text = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def cut_at_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of texts start, each a run of spaces and what follows it, and which of them begin a text."""
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[inner] = True
    head = np.zeros(len(data), bool)
    head[inner] = True
    start = np.flatnonzero(cut)
    return start, head[start]


def worker_codec(model_file: str, scores: np.ndarray | None = None) -> Codec:
    """The codec of this worker process, with these scores."""
    held = worker_state().setdefault("codecs", {})
    if model_file not in held:
        held[model_file] = Codec(model_file)
    codec = held[model_file]
    wanted = codec.by_rank if scores is None else scores
    if codec.scores != wanted.tolist():
        codec.use(wanted)
    return codec


def fit_scores(docs: DataFrame, model_file: str, text_col: str = "text", rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces by expectation and maximisation over all documents, one for each piece of the file.

    The distinct parts of all texts are counted once. Each round sums the pieces' expected counts over the segmentations
    of every part; what reaches the driver is a number a piece. No piece counts less than LEAST, so all stay possible.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_file)
        table, names, seen = None, [], np.zeros(0, np.int64)

        def name(stretches: list[bytes], head: list[bool]) -> list[bytes]:
            names.extend(codec.stretch_parts(stretches, head))
            return [b""] * len(stretches)

        def told() -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for parts, n in zip(names, seen.tolist()):
                for part in parts:
                    total[part] += n
            parts, n = list(total), list(total.values())
            for at in range(0, len(parts), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(parts[at : at + 10_000], pa.string()), pa.array(n[at : at + 10_000], pa.int64())], names=["part", "n"])

        for batch in batches:
            for _, data, offsets in text_groups(batch, 0):
                table = table or StretchTable(name, COUNTED)
                found = np.bincount(table.entries(data, *cut_at_spaces(data, offsets)), minlength=table.count)
                found[: len(seen)] += seen
                seen = found
                if table.count > COUNTED // 2:  # handed on, and counted anew
                    yield from told()
                    table, seen = None, np.zeros(0, np.int64)
                    names.clear()
        yield from told()

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "part string, n long")
    parts = written(counted.groupBy("part").agg(F.sum("n").alias("n")), "piece-parts")
    codec = worker_codec(model_file)
    scores = codec.by_rank
    for _ in range(rounds):
        told = docs.sparkSession.sparkContext.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = worker_codec(model_file, told.value)
            total = np.zeros(len(own.pieces), np.int64)
            for batch in batches:
                total += own.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["piece", "n"])

        sums = parts.mapInArrow(expect, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(scores))
        counts[sums["piece"].to_numpy()] = sums["n"].to_numpy() / SCALE
        if not counts.any():
            break
        counts = np.maximum(counts[codec.vocabulary], LEAST)
        scores = np.zeros(len(scores))
        scores[codec.vocabulary] = np.log(counts / counts.sum())
    return scores


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", with_ids: bool = True, keep: list[str] | None = None, scores: np.ndarray | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with n_tokens, n_bytes (ids of byte pieces), ids_crc32, decoded_sha256 and, with_ids, ids.

    scores: log scores of the pieces, by default those that fit_scores estimates from docs. ids are the text's pieces;
    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers, and decoded_sha256 the SHA-256 of what
    the ids decode to, which is the text's own. Null and empty texts have no ids; repeated rows are encoded each; an empty
    table gives an empty one; columns of these names are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(fit_scores(docs, model_file, text_col) if scores is None else scores)
    kinds = {"n_tokens": "long", "n_bytes": "long", "ids_crc32": "long", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})
    kept = [c for c in (docs.columns if keep is None else keep) if c not in kinds]
    plain = [f"c{i}" for i in range(len(kept))]  # whatever they are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_file, told.value)
        for batch in batches:
            for part, data, offsets in text_groups(batch, len(kept)):
                flat, sizes = codec.encode_bytes(data, offsets)
                ends = np.cumsum(sizes)
                fallback = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])
                each = np.split(flat, ends[:-1])
                columns = [
                    pa.array(sizes, pa.int64()),
                    pa.array(fallback[ends] - fallback[ends - sizes], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4", copy=False).tobytes()) for ids in each], pa.int64()),
                    pa.array([hashlib.sha256(codec.decode(ids)).hexdigest() for ids in each], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*plain, *kinds])

    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)), F.coalesce(F.col(text_col), F.lit("")).alias("source"))
    return rows.mapInArrow(run, ", ".join([f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(kept, plain)] + [f"{c} {k}" for c, k in kinds.items()])).toDF(*kept, *kinds)
