"""A SentencePiece model file as a lattice: Viterbi over sorted words with shared prefixes, and a count-only Viterbi.

The pieces of a file are read as the file says, or as a unigram vocabulary, and give the ids that the library gives for them:

* unigram: the forward score of a prefix is the best sum of piece scores, in 32-bit floats; of equal sums the longer last
  piece wins; a character without a piece costs 10 more than the worst piece and becomes its bytes. Sums begin anew with
  each marked word, so they don't lose digits in a long text as sums over the whole text do.
* bpe: merges in order of score fix which pieces may stand side by side. Two neighbours are allowed when undoing their
  merges, latest first, never meets a better merge across the border. A segmentation whose neighbours are all allowed is
  the tokenizer's own, and each prefix has exactly one, so the forward value of a prefix is its last piece.

Either way a prefix's forward value depends on the prefix alone. Words are sorted, which lays them out as the depth-first
walk of their trie, and each word keeps the values of the prefix it shares with the word before.

Texts are cut in marked words (runs of the space mark, then other characters): no piece reaches over the start of one,
which is checked when the file is read, so distinct words are encoded once a batch.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bound on a model's pieces: every task holds them.
MAX_PIECES = 1 << 20
#: Words that a worker remembers between batches, in each of two generations; forgetting changes no result.
CACHED_WORDS = 100_000
CACHED_PAIRS = 200_000
#: Scores from here down mark pieces of a bpe file that no merge makes.
PLACEHOLDER = -1e8
#: Text bytes that are encoded at once.
SLICE_BYTES = 2 << 20


class _Memory:
    """What was made of the latest words: when the newer generation is full, the older one goes."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def of(self, words: list[str], make) -> list:
        """make(sorted words that aren't remembered) gives their values; returns those of all words."""
        new, old = self.new, self.old
        missing = sorted(w for w in words if w not in new and w not in old)
        made = dict(zip(missing, make(missing)))
        out = [made[w] if w in made else new[w] if w in new else old[w] for w in words]
        if len(new) + len(words) > self.limit:
            self.old, self.new = new, {}
        self.new.update(zip(words[: self.limit], out))
        return out


def as_unigram(blob: bytes) -> bytes:
    """The model file with its pieces as a unigram vocabulary. Scores up to PLACEHOLDER, which stand for none, become one less than the worst other score."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(blob)
    proto.trainer_spec.model_type = 1
    worst = min((p.score for p in proto.pieces if p.type == 1 and p.score > PLACEHOLDER), default=0.0)
    for p in proto.pieces:
        p.score = p.score if p.score > PLACEHOLDER else worst - 1
    return proto.SerializeToString()


class PieceModel:
    def __init__(self, blob: bytes, kind: str | None = None):
        """blob: the model file. kind: 'unigram' to read the pieces of any file so (see as_unigram)."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(blob if kind is None else as_unigram(blob))
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        self.kind = {1: "unigram", 2: "bpe"}.get(spec.model_type, "other")
        if self.kind not in ("unigram", "bpe") or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and bpe models with byte fallback, a leading mark and no normalisation are supported")
        if len(proto.pieces) > MAX_PIECES:
            raise ValueError(f"a model of over {MAX_PIECES} pieces")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = [0] * 256
        self.surface = [b""] * len(self.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 4:
                raise ValueError("user-defined pieces are not supported")
        self.scores = [np.float32(p.score) for p in proto.pieces]
        normal = [p.score for p in proto.pieces if p.type == 1]
        self.unknown = np.float32(np.float32(min(normal, default=0.0)) - np.float32(10))
        #: words of so many characters have sums of whole numbers below 2^24, which plain floats add as 32-bit ones would
        whole = all(float(x).is_integer() for x in self.scores)
        self.short = int(2**24 // max(1.0, *(abs(float(x)) for x in (*self.scores, self.unknown)))) if whole else 0
        self.floats = [float(x) for x in self.scores]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        if self.kind == "bpe":
            if any(c not in self.ids for p in self.ids for c in p):
                raise ValueError("a bpe model needs every character as a piece")
            self._undo({-x for x, n in Counter(normal).items() if n > 1})
        #: for the last three characters of a piece the length of the longest piece that ends so
        self.reach: dict[str, int] = {}
        for p, i in self.ids.items():
            if len(p) > 2 and (self.kind == "unigram" or self.whole[i]):
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        self._fresh()

    def _fresh(self) -> None:
        self.words, self.counts = _Memory(CACHED_WORDS), _Memory(CACHED_WORDS)
        self.pairs: dict[int, bool] = {}
        self.automaton = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "counts", "pairs", "automaton")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    # bpe: when pieces are made, and from what
    def _merged(self, parts: list[str]) -> tuple[list[str], list[float], tuple[str, str] | None]:
        """Merges by score, leftmost first: what is left, the time of each merge, and the last pair."""
        times, last = [], None
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or -self.scores[j] < best):
                    best, at = -self.scores[j], i
            if best is None:
                return parts, times, last
            times.append(float(best))
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _undo(self, shared: set[float]) -> None:
        """For each piece: its time (-inf for a character), its last two parts, whether its text gives it back, and whether its merges come in order of times that it shares with no other piece."""
        n = len(self.pieces)
        self.time, self.left, self.right = [float("-inf")] * n, [-1] * n, [-1] * n
        self.whole, self.plain = [False] * n, [True] * n
        for p, i in self.ids.items():
            if len(p) == 1:
                self.whole[i] = True
                continue
            rest, times, last = self._merged(list(p))
            self.time[i] = -float(self.scores[i])
            self.whole[i] = rest == [p]
            if self.whole[i]:
                self.left[i], self.right[i] = self.ids[last[0]], self.ids[last[1]]
                self.plain[i] = all(a <= b for a, b in zip(times, times[1:])) and shared.isdisjoint(times)

    def _allowed(self, a: int, b: int) -> bool:
        if not (self.plain[a] and self.plain[b]):
            return self._merged([*self.pieces[a], *self.pieces[b]])[0] == [self.pieces[a], self.pieces[b]]
        pieces, ids, time = self.pieces, self.ids, self.time
        limit, never = float("inf"), float("-inf")
        while True:
            c = ids.get(pieces[a] + pieces[b])
            if c is not None and time[c] < limit:
                return False
            if time[a] > time[b]:
                limit, a = time[a], self.right[a]
            elif time[b] == never:
                return True
            else:  # of two equal merges the left one comes first
                limit, b = time[b] + 0.5, self.left[b]

    def allowed(self, a: int, b: int) -> bool:
        key = a * MAX_PIECES + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._allowed(a, b)
        return found

    # encoding: the trie walk
    def encode_sorted(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the sorted marked words."""
        out = []
        forward = self._forward_bpe if self.kind == "bpe" else self._forward_unigram
        last: list[int] = [-1]  # of the prefix of each length: the last piece, or below -1 an unknown character
        best: list = [np.float32(0) if not self.short else 0.0]
        before = ""
        for word in words:
            n = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], best[n + 1 :]
            forward(word, n, last, best)
            out.append(self._back(word, last))
            before = word
        return out

    def _forward_bpe(self, word: str, n: int, last: list[int], best: list) -> None:
        ids, whole, allowed, reach = self.ids, self.whole, self.allowed, self.reach
        for end in range(n + 1, len(word) + 1):
            found = -2 - ord(word[end - 1])
            for start in range(max(0, end - reach.get(word[end - 3 : end], 2)) if end > 2 else 0, end):
                i = ids.get(word[start:end])
                if i is not None and whole[i] and ((p := last[start]) < 0 or allowed(p, i)):
                    found = i
                    break
            last.append(found)

    def _forward_unigram(self, word: str, n: int, last: list[int], best: list) -> None:
        ids, reach = self.ids, self.reach
        scores, unknown = self._scores(word)
        for end in range(n + 1, len(word) + 1):
            found, top = None, None
            for start in range(max(0, end - reach.get(word[end - 3 : end], 2)) if end > 2 else 0, end):
                i = ids.get(word[start:end])
                if i is not None and (top is None or best[start] + scores[i] > top):
                    found, top = i, best[start] + scores[i]
            if word[end - 1] not in ids and (top is None or best[end - 1] + unknown > top):
                found, top = -2 - ord(word[end - 1]), best[end - 1] + unknown
            last.append(found)
            best.append(top)

    def _scores(self, word: str) -> tuple[list, float]:
        """Scores in the numbers with which the sums of this word are right, and that of an unknown character."""
        return (self.floats, float(self.unknown)) if len(word) <= self.short else (self.scores, self.unknown)

    def _back(self, word: str, last: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        at = len(word)
        while at:
            i = last[at]
            if i < 0:
                out.extend(self.bytes[b] for b in reversed(chr(-2 - i).encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(i)
                at -= len(self.pieces[i])
        out.reverse()
        return tuple(out)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        return self.words.of(words, self.encode_sorted)

    # counting: every match from an Aho-Corasick automaton, only the number of pieces is carried along
    def count_words(self, words: list[str]) -> list[int]:
        return self.counts.of(words, lambda new: map(self._count, new))

    def _count(self, word: str) -> int:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p, i in self.ids.items():
                if self.kind == "unigram" or self.whole[i]:
                    self.automaton.add_word(p, (i, len(p)))
            self.automaton.make_automaton()
        return self._count_unigram(word) if self.kind == "unigram" else self._count_bpe(word)

    def _count_unigram(self, word: str) -> int:
        """Best score and number of pieces of each prefix; matches come by end, the longest first."""
        size, ids = len(word), self.ids
        scores, unknown = self._scores(word)
        n, best = [0] * (size + 1), [None] * (size + 1)
        best[0] = scores[0] * 0
        if odd := [i for i, c in enumerate(word) if c not in ids]:
            odd.reverse()
        for at, (i, length) in self.automaton.iter(word):
            while odd and odd[-1] < at:  # no more matches end there
                self._step(word, odd.pop(), n, best, unknown)
            start, end = at + 1 - length, at + 1
            score = best[start] + scores[i]
            if best[end] is None or score > best[end]:
                best[end], n[end] = score, n[start] + 1
        while odd:
            self._step(word, odd.pop(), n, best, unknown)
        return n[size]

    @staticmethod
    def _step(word: str, at: int, n: list[int], best: list, unknown: float) -> None:
        """The character at a place as an unknown one, if that is better than the matches that end there."""
        if best[at + 1] is None or best[at] + unknown > best[at + 1]:
            best[at + 1], n[at + 1] = best[at] + unknown, n[at] + len(word[at].encode("utf-8", "surrogatepass"))

    def _count_bpe(self, word: str) -> int:
        size, allowed = len(word), self.allowed
        n, last = [0] * (size + 1), [-1] * (size + 1)
        done = 0

        def close(end: int) -> None:
            """Settles prefixes up to end, which get no more matches."""
            nonlocal done
            while done < end:
                done += 1
                if last[done] == -1:
                    last[done], n[done] = -2, n[done - 1] + len(word[done - 1].encode("utf-8", "surrogatepass"))

        for at, (i, length) in self.automaton.iter(word):
            end = at + 1
            if end - 1 > done:
                close(end - 1)
            if last[end] == -1 and ((p := last[end - length]) < 0 or allowed(p, i)):
                last[end], n[end] = i, n[end - length] + 1
        close(size)
        return n[size]

    # batches
    def _words(self, texts: pa.Array) -> pa.ListArray:
        """Marked words of each text; of null and empty text none."""
        odd = pc.fill_null(pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, MARK), pc.equal(texts, ""))), True)
        plain = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets, words = plain.offsets, pc.binary_join_element_wise(MARK, plain.flatten(), "")
        found = pa.ListArray.from_arrays(offsets, words)
        if not pc.any(odd).as_py():
            return found
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = [_CHUNK.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts.take(pa.array(rows)).to_pylist()]
        order = np.arange(len(texts))
        order[rows] = len(texts) + np.arange(len(rows))
        return pa.concat_arrays([found, pa.array(cut, found.type)]).take(pa.array(order))

    def _slices(self, texts: pa.Array):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        start = 0
        while start < len(texts):
            limit = (sizes[start - 1] if start else 0) + SLICE_BYTES
            end = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
            yield texts.slice(start, end - start)
            start = end

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; none of null."""
        return pa.concat_arrays([self._encode(x) for x in self._slices(texts)] or [pa.array([], pa.list_(pa.int32()))])

    def _encode(self, texts: pa.Array) -> pa.ListArray:
        lists = self._words(texts)
        coded = lists.flatten().dictionary_encode()
        found = self.encode_words(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        per_word = lengths[index]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        ids = flat[np.repeat(starts[index] - ends[:-1], per_word) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(ids))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without the ids."""
        out = []
        for part in self._slices(texts):
            lists = self._words(part)
            coded = lists.flatten().dictionary_encode()
            n = np.array(self.count_words(coded.dictionary.to_pylist()), np.int64)
            ends = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy()])]) if len(n) else np.zeros(1, np.int64)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out.append(np.diff(ends[offsets]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list of ids: marks become spaces, bytes are joined, ill-formed UTF-8 becomes U+FFFD, one leading space goes."""
        table = pa.array(self.surface, pa.binary())
        flat = table.take(ids.flatten())
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), b"")
        try:
            text = whole.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())
        return pc.replace_substring_regex(text, r"\A ", "")


def load(path: str, kind: str | None = None) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read(), kind)
