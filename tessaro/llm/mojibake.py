"""Text that was read with the wrong character encoding: found, and restored where possible.

A smoothed character n-gram model is trained on the corpus's clean passages; its counts lie in
tables of a fixed size, so the model is as small for 100 TB as for a page. Every run of
non-ASCII characters is put through every candidate chain of encoding and decoding (twice over
for text that was garbled twice); the likeliest reading in its context wins, if it beats the run
as it stands by more than a margin. The margin is set on all clean passages, as they are and
garbled on purpose, each judged by a model trained on the other half of the texts only.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOST = "�"
#: Sizes of the tables of trigrams, bigrams and single characters.
TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
#: Single-byte encodings; bytes they leave undefined stand for themselves, as in lenient decoders.
_SINGLE = (
    "cp1252", "latin_1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "cp1254", "cp437", "cp850", "cp852", "mac_roman", "iso8859_15",
)
_MULTI = ("gbk", "cp932", "euc_jp", "big5", "euc_kr")
_WESTERN = ("cp1252", "latin_1")
#: (read as, really): what was written as the second was read as the first.
CHAINS = (
    [(w, "utf_8") for w in (*_SINGLE, *_MULTI)]
    + [(w, t) for w in _WESTERN for t in ("cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "gbk", "cp932", "euc_jp", "big5", "euc_kr", "mac_roman", "cp437", "cp850")]
    + [(w, t) for w in ("cp1251", "koi8_r", "cp866", "iso8859_5") for t in ("cp1251", "koi8_r", "cp866", "iso8859_5") if w != t]
    + [(w, "cp1252") for w in ("latin_1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253")]
    + [("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"), ("cp850", "cp1250"), ("cp852", "cp1250"), ("iso8859_7", "cp1253"), ("gbk", "cp1251"), ("cp932", "euc_jp")]
)
#: Chains in which a character may take a byte of ASCII along.
_WHOLE = [c for c in CHAINS if {*c} & {"gbk", "cp932", "big5"}]
#: What a chain must gain beyond the margin, in nats: a valid UTF-8 sequence hardly arises by chance.
_COST = {"utf_8": 0.0, "gbk": 3.0, "cp932": 3.0, "euc_jp": 3.0, "big5": 3.0, "euc_kr": 3.0}
_LEGACY_COST = 4.0

_CONTROL = re.compile(r"[\x80-\x9f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_QUOTED = re.compile(r"`[^`\n]*`")
_SENTENCE = re.compile(r"(?<=[\n。！？])|(?<=[.!?…])(?=\s)")


_ALIKE = bytes(48 if 49 <= b <= 57 else b for b in range(256))


def alike(text: str) -> str:
    """The text as the model sees it: all digits are the same. In UTF-8 their bytes stand for nothing else."""
    return text.encode("utf_8", "surrogatepass").translate(_ALIKE).decode("utf_8", "surrogatepass")


def _characters(codec: str) -> str:
    """What each of the 256 bytes is read as; one left undefined stands for itself."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


_CHARACTERS = {c: _characters(c) for c in _SINGLE}
_BYTES = {c: codecs.charmap_build(table) for c, table in _CHARACTERS.items()}


def as_bytes(text: str, codec: str) -> bytes | None:
    """The bytes that were read as text, or null if this encoding can't have produced it."""
    try:
        return codecs.charmap_encode(text, "strict", _BYTES[codec])[0] if codec in _BYTES else text.encode(codec)
    except UnicodeEncodeError:
        return None


def readings(run: str) -> dict[str, tuple[tuple[str, str], ...]]:
    """Every text that some chain makes of the run, with the shortest chain."""
    out: dict[str, tuple[tuple[str, str], ...]] = {}
    fresh = {run: ()}
    for depth in range(3):
        following: dict[str, tuple[tuple[str, str], ...]] = {}
        for text, path in fresh.items():
            raw: dict[str, bytes | None] = {}
            for w, t in CHAINS if not depth else CHAINS[: len(_SINGLE) + len(_MULTI)]:
                if w not in raw:
                    raw[w] = as_bytes(text, w)
                if raw[w] is None:
                    continue
                try:
                    read = raw[w].decode(t)
                except UnicodeDecodeError:
                    continue
                if read != text and read != run and read not in out:
                    out[read] = (*path, (w, t))
                    # only what came out of UTF-8, and can be UTF-8 again, is taken on
                    if t == "utf_8" and not read.isascii():
                        following[read] = out[read]
        fresh = following
        if not fresh:
            break
    return out


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((x >= 49) & (x <= 57), 48, x)  # digits are all alike


def _hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table places of the trigrams abc, the bigrams bc and the characters c."""
    return ((a * 2654435761 ^ b * 40503 ^ c * 2246822519) >> 7) & (TRI - 1), ((b * 2654435761 ^ c * 40503) >> 5) & (BI - 1), c & (UNI - 1)


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table places of the n-grams that end at each character from the third on."""
    return _hashes(x[:-2], x[1:-1], x[2:])


#: Taken off every count, so that a text garbled once doesn't vouch for itself: so much at least, and this share of
#: all characters, half of what a place among the trigrams holds on average. So the corpus's size doesn't matter.
DISCOUNT, DISCOUNT_SHARE = 3.0, 0.5 / TRI
#: Likelihood of what was never seen: in a text as it stands, and in a reading of it, which has more to prove.
UNSEEN, UNSEEN_READ = 1e-5, 1e-9
#: The share of an unseen trigram in all, alike.
RARE, RARE_READ = 1e-7, 1e-9


class Model:
    """Interpolated character trigrams over hashed, discounted counts."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray, uni: np.ndarray):
        self.tri, self.bi, self.uni, self.total = tri, bi, uni, max(1.0, float(uni.sum()))
        self.discount = max(DISCOUNT, DISCOUNT_SHARE * self.total)

    def _less(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(n - self.discount, 0.0)

    def _likely(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, unseen: float) -> np.ndarray:
        """Negative log likelihood of the characters c, each after a and b."""
        tri, bi, uni = _hashes(a, b, c)
        _, before, _ = _hashes(a, a, b)  # the contexts are n-grams themselves
        p = 0.6 * self._less(self.tri[tri]) / np.maximum(self.bi[before], 1.0)
        p += 0.3 * self._less(self.bi[bi]) / np.maximum(self.uni[b & (UNI - 1)], 1.0) + 0.1 * self._less(self.uni[uni]) / self.total + unseen
        return -np.log(np.minimum(p, 1.0))

    def _frequent(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, unseen: float) -> np.ndarray:
        """Negative logarithms of the trigrams' shares in all."""
        return -np.log(self._less(self.tri[_hashes(a, b, c)[0]]) / self.total + unseen)

    def _added(self, score: Callable, texts: list[str], unseen: float, most: np.ndarray | None) -> np.ndarray:
        """The score of each text's characters from the third on, added up; infinite once it exceeds `most`.

        All texts are scored together, a few characters further each time, so that a reading that
        is no good costs its beginning only.
        """
        x = _codes("".join(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin, out = np.cumsum(size) - size, np.zeros(len(texts))
        alive, at, step = np.flatnonzero(size > 2), 2, 8 if most is not None else 1 << 40
        while len(alive):
            n = np.minimum(size[alive] - at, step)
            first = np.cumsum(n) - n
            i = np.arange(n.sum()) + np.repeat(begin[alive] + at - first, n)
            out[alive] += np.add.reduceat(score(x[i - 2], x[i - 1], x[i], unseen), first)
            if most is not None:
                lost = alive[out[alive] >= most[alive]]
                out[lost] = np.inf
            at, step = at + step, 2 * step
            alive = alive[(size[alive] > at) & (out[alive] < np.inf)]
        return out

    def losses(self, texts: list[str], unseen: float = UNSEEN, most: np.ndarray | None = None) -> np.ndarray:
        """Negative log likelihood of each text's third character onward; infinite where it reaches `most`."""
        return self._added(self._likely, texts, unseen, most)

    def rarities(self, texts: list[str], unseen: float = RARE, most: np.ndarray | None = None) -> np.ndarray:
        """Negative logarithms of the trigrams' shares in all, added up per text.

        Other than by their likelihood after one another, a language's garbled texts stay rarer than
        its clean ones, however many of them there are.
        """
        return self._added(self._frequent, texts, unseen, most)

    def loss(self, text: str, unseen: float = UNSEEN) -> float:
        return float(self.losses([text], unseen)[0])

    def rarity(self, text: str, unseen: float = RARE) -> float:
        return float(self.rarities([text], unseen)[0])


def _bare(text: str) -> str:
    """The text without what stands between backticks."""
    return _QUOTED.sub(lambda m: "`" + "x" * (len(m[0]) - 2) + "`", text)


def _is_utf8(run: str) -> bool:
    """Whether some encoding turns the run into bytes that are valid UTF-8 and something else."""
    for w in (*_SINGLE, *_MULTI):
        raw = as_bytes(run, w)
        if raw is not None:
            try:
                if raw.decode("utf_8") != run:
                    return True
            except UnicodeDecodeError:
                pass
    return False


class Suspects:
    """Tells passages to leave out of a first training: those with losses, controls, or mostly of runs that are UTF-8 bytes."""

    def __init__(self) -> None:
        self.known: dict[str, bool] = {}

    def __call__(self, passage: str) -> bool:
        if LOST in passage or _CONTROL.search(passage):
            return True
        size = odd = 0
        for run in _RUN.findall(passage):
            if run not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[run] = _is_utf8(run)
            size += len(run)
            odd += len(run) * self.known[run]
        # A clean word may happen to be valid UTF-8 in some encoding, a clean sentence hardly.
        return 2 * odd >= size > 0


def passages(text: str) -> list[str]:
    """The passages of a text, as the model sees them, without what is quoted."""
    return _SENTENCE.split(_bare(alike(text)))


def _counter(batches: Iterator[pd.DataFrame], suspects: Callable[[int], Callable[[list[str]], list[bool]]]) -> Iterator[pd.DataFrame]:
    """The counts (part, at, n) of the passages of each half's texts; suspects(half) says of passages which to leave out."""
    done: dict[int, np.ndarray] = {}
    tell: dict[int, Callable] = {}
    for rows in batches:
        for part, own in rows.groupby("half")["text"]:
            if part not in done:
                done[part], tell[part] = np.zeros(TRI + BI + UNI, np.int64), suspects(int(part))
            tables = done[part]
            for texts in _portions([t for t in own if t]):
                cut = [[t] if t.isascii() else passages(t) for t in texts]
                asked = list(dict.fromkeys(p for t in cut for p in t if not p.isascii()))
                left_out = {p for p, odd in zip(asked, tell[part](asked)) if odd}
                x = _codes("\n\n" + "\n\n".join("".join("\n" if p in left_out else p for p in t) for t in cut))
                for first, size, at in zip((0, TRI, TRI + BI), (TRI, BI, UNI), _places(x)):
                    tables[first : first + size] += np.bincount(at, minlength=size)
    for part, tables in done.items():
        at = np.flatnonzero(tables)
        yield pd.DataFrame({"part": part, "at": at, "n": tables[at]})


def _portions(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in portions of about so many characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Restorer:
    """Judges and restores texts by a model and a margin; remembers runs it has seen."""

    #: Runs in their contexts, and passages, that are remembered at a time.
    MOST = 200_000

    def __init__(self, model: Model, margin: float):
        self.model, self.margin = model, margin
        self.known: dict[tuple[str, str, str], tuple[float, str, tuple]] = {}
        self.read: dict[str, dict] = {}
        self.rare: dict[tuple[str, str, str], float] = {}
        self.judged: dict[str, bool] = {}
        self.gains: dict[str, float] = {}

    def _runs(self, texts: Iterable[str], seen: dict) -> list[tuple[str, str, str]]:
        """The (two characters before, run, two after) of all runs that aren't in `seen`, and have readings."""
        if len(seen) > self.MOST:
            seen.clear()
        if len(self.read) > self.MOST:
            self.read.clear()
        fresh = {}
        for text in texts:
            for m in _RUN.finditer(text):
                key = (text[max(0, m.start() - 2) : m.start()], m[0], text[m.end() : m.end() + 2])
                if key not in seen:
                    fresh[key] = None
        for key in fresh:
            if key[1] not in self.read:
                self.read[key[1]] = readings(key[1])
        return list(fresh)

    def learn(self, texts: Iterable[str]) -> None:
        """Find (gain over the run as it stands, reading, chain) of the likeliest reading of all runs, each in its context."""
        keys = self._runs(texts, self.known)
        here = self.model.losses(["".join(k) for k in keys])
        tried, most, owner = [], [], []
        for i, ((left, run, right), loss) in enumerate(zip(keys, here.tolist())):
            self.known[keys[i]] = (0.0, run, ())
            for read, chain in self.read[run].items():
                # No reading can gain more than the run loses, so most need no scoring.
                limit = loss - _COST.get(chain[-1][1], _LEGACY_COST)
                if limit > 0:
                    tried.append(left + read + right)
                    most.append(limit)
                    owner.append((i, read, chain))
        most = np.array(most)
        gain = most - self.model.losses(tried, UNSEEN_READ, most)
        for j in np.flatnonzero(gain > 0).tolist():
            i, read, chain = owner[j]
            self.known[keys[i]] = max(self.known[keys[i]], (float(gain[j]), read, chain))

    def best(self, left: str, run: str, right: str) -> tuple[float, str, tuple]:
        """(gain, reading, chain) of a run in its context."""
        key = (alike(left), run, alike(right))
        if key not in self.known:
            self.learn(["".join(key)])
        return self.known[key]

    def compare(self, texts: Iterable[str]) -> None:
        """By how much readings of runs, other than as UTF-8, consist of more frequent trigrams, in nats.

        For training only: where garbled texts were counted too, likelihoods don't tell them from clean ones.
        """
        keys = self._runs(texts, self.rare)
        here = self.model.rarities(["".join(k) for k in keys])
        tried, most, owner = [], [], []
        for i, ((left, run, right), rare) in enumerate(zip(keys, here.tolist())):
            self.rare[keys[i]] = 0.0
            for read, chain in self.read[run].items():
                limit = rare - _COST.get(chain[-1][1], _LEGACY_COST)
                if chain[-1][1] != "utf_8" and limit > 0:
                    tried.append(left + read + right)
                    most.append(limit)
                    owner.append(keys[i])
        most = np.array(most)
        gain = most - self.model.rarities(tried, RARE_READ, most)
        for j in np.flatnonzero(gain > 0).tolist():
            self.rare[owner[j]] = max(self.rare[owner[j]], float(gain[j]))

    def _together(self, text: str, known: dict) -> tuple[float, int]:
        """The gain of a passage's runs added up, and how many characters of them stand for single bytes."""
        gain, single = 0.0, 0
        for m in _RUN.finditer(text):
            more, _, chain = known[text[max(0, m.start() - 2) : m.start()], m[0], text[m.end() : m.end() + 2]]
            if more > 0:
                gain += more
                single += len(m[0]) if chain[-1][1] != "utf_8" else 2
        return gain, single

    def _wholes(self, texts: list[str], gains: list[float], score: Callable, unseen: float, chains: list[tuple[str, str]]) -> Iterator[tuple[int, float, str, tuple[str, str]]]:
        """(which text, gain, reading, chain) of passages that gain more as a whole, where one character took an ASCII byte along."""
        here = score(texts)
        tried, most, owner = [], [], []
        for i, (text, gain, loss) in enumerate(zip(texts, gains, here.tolist())):
            for w, t in chains:
                raw = as_bytes(text, w)
                try:
                    whole = text if raw is None else raw.decode(t)
                except UnicodeDecodeError:
                    continue
                limit = loss - _COST.get(t, _LEGACY_COST) - gain
                if whole != text and limit > 0:
                    tried.append(whole)
                    most.append(limit)
                    owner.append((i, (w, t)))
        most = np.array(most)
        more = most - score(tried, unseen, most)
        for j in np.flatnonzero(more > 0).tolist():
            i, chain = owner[j]
            yield i, gains[i] + float(more[j]), tried[j], chain

    def gains_of(self, texts: list[str]) -> list[float]:
        """The gains of passages as the model sees them."""
        self.learn(texts)
        gains = []
        for text in texts:
            gain, single = self._together(text, self.known)
            # One rare symbol may look like another one's byte; a passage of one has more to prove.
            gains.append(gain - _LEGACY_COST if single == 1 else gain)
        open_ = [i for i, (text, gain) in enumerate(zip(texts, gains)) if gain > 0 or _CONTROL.search(text)]
        for j, gain, _, _ in self._wholes([texts[i] for i in open_], [gains[i] for i in open_], self.model.losses, UNSEEN_READ, _WHOLE):
            gains[open_[j]] = max(gains[open_[j]], gain)
        shut = set(range(len(texts))).difference(open_)
        return [0.0 if i in shut else g for i, g in enumerate(gains)]

    def suspects(self, texts: list[str]) -> list[bool]:
        """Of passages as the model sees them, which to leave out of a second training."""
        if len(self.judged) > self.MOST:
            self.judged.clear()
        fresh = [p for p in dict.fromkeys(texts) if p not in self.judged]
        self.judged |= {p: gain > 0 or LOST in p or bool(_CONTROL.search(p)) for p, gain in zip(fresh, self.gains_of(fresh))}
        unsure = [p for p in fresh if not self.judged[p]]
        self.compare(unsure)
        rare = [sum(self.rare[text[max(0, m.start() - 2) : m.start()], m[0], text[m.end() : m.end() + 2]] for m in _RUN.finditer(text)) for text in unsure]
        self.judged |= {p: True for p, gain in zip(unsure, rare) if gain > 0}
        unsure = [p for p in unsure if not self.judged[p]]
        for i, _, _, _ in self._wholes(unsure, [0.0] * len(unsure), self.model.rarities, RARE_READ, [c for c in _WHOLE if c[1] != "utf_8"]):
            self.judged[unsure[i]] = True
        return [self.judged[p] for p in texts]

    def passage(self, text: str) -> tuple[float, str, list[tuple]]:
        """The gain of a passage's runs together, the passage restored, and the chains."""
        gain, single, runs, weight = 0.0, 0, [], {}
        for m in _RUN.finditer(text):
            left, right = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
            more, read, chain = self.best(left, m[0], right)
            if more > 0:
                gain += more
                single += len(m[0]) if chain[-1][1] != "utf_8" else 2
                weight[chain] = weight.get(chain, 0.0) + more
            runs.append((m, left, right, more, read, chain))
        if single == 1:
            gain -= _LEGACY_COST  # as in gains_of()
        if gain <= 0 and not _CONTROL.search(text):
            return 0.0, text, []
        # Runs too short to tell by themselves follow the chain that explains most of the passage.
        leading = max(weight, key=weight.get, default=())
        out, at, chains = [], 0, []
        for m, left, right, more, read, chain in runs:
            if weight and chain != leading:
                same = next((r for r, c in readings(m[0]).items() if c == leading), None)
                if same is not None and self.model.loss(left + same + right, UNSEEN_READ) <= self.model.loss(left + (read if more > 0 else m[0]) + right) + 2.0:
                    more, read, chain = 1.0, same, leading
            if more > 0:
                chains.append(chain)
                out += [text[at : m.start()], read]
                at = m.end()
        read = "".join([*out, text[at:]])
        for _, more, whole, chain in self._wholes([text], [gain], self.model.losses, UNSEEN_READ, _WHOLE):
            if more > gain:
                gain, read, chains = more, whole, [(chain,)]
        return gain, read, chains

    def weigh(self, texts: Iterable[str | None]) -> None:
        """Find the gains of all passages of the texts at once; text() then looks them up."""
        if len(self.gains) > self.MOST:
            self.gains.clear()
        fresh = list(dict.fromkeys(p for t in texts if t and not t.isascii() for p in passages(t) if p not in self.gains and not p.isascii()))
        self.gains |= dict(zip(fresh, self.gains_of(fresh)))

    def gain(self, part: str) -> float:
        """A passage's gain, which depends on what the model sees only."""
        key = alike(part)
        if key not in self.gains:
            self.gains[key] = self.gains_of([key])[0]
        return self.gains[key]

    def text(self, text: str | None) -> tuple[bool, str | None, list[str], bool]:
        """(garbled, restored text, chains, whether all of it could be restored)."""
        if not text or text.isascii():
            return False, text, [], True
        bare, out, garbled, lost, used = _bare(text), [], False, False, set()
        at = 0
        for part in _SENTENCE.split(bare):
            whole = text[at : at + len(part)]
            at += len(part)
            if part.isascii():
                out.append(whole)
                continue
            if self.gain(part) > self.margin:
                _, read, chains = self.passage(part)
                garbled = True
                used |= {"+".join(f"{w}>{t}" for w, t in c) for c in chains}
                out.append(read if part == whole else self.passage(whole)[1])
                lost = lost or LOST in read
            else:
                out.append(whole)
                if LOST in part:
                    garbled = lost = True
        return garbled, "".join(out), sorted(used), not lost


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return model.tri, model.bi, model.uni


def _gathered(documents: DataFrame, count: Callable) -> list[Model]:
    """The models of the first half, of the second, and of the whole, whose counts are those of both."""
    counts = documents.select("text", half(F.col("text")).alias("half")).mapInPandas(count, "part int, at bigint, n bigint").groupBy("part", "at").agg(F.sum("n").alias("n")).toPandas()
    halves = []
    for part in range(2):
        own, tables = counts[counts["part"] == part], np.zeros(TRI + BI + UNI, np.float32)
        tables[own["at"].to_numpy(np.int64)] = own["n"].to_numpy(np.float32)
        halves.append(tables)
    return [Model(t[:TRI], t[TRI : TRI + BI], t[TRI + BI :]) for t in (*halves, halves[0] + halves[1])]


def half(text: Column) -> Column:
    """The half of the corpus that a text belongs to, with all its copies."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def train(spark: SparkSession, documents: DataFrame) -> list[Model]:
    """The models of the clean passages of each half and of all texts; their tables have TRI + BI + UNI places, whatever the corpus.

    A first training leaves out what looks wrong by its bytes, a second one what the first
    model would rather read otherwise, and what has a reading of more frequent trigrams. A
    half's model has seen nothing of the other half in either training.
    """

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suspect = Suspects()
        return _counter(batches, lambda part: lambda texts: [suspect(p) for p in texts])

    first = _gathered(documents, once)
    shared = spark.sparkContext.broadcast([_tables(m) for m in first[:2]])

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _counter(batches, lambda part: Restorer(Model(*shared.value[part]), 0.0).suspects)

    return _gathered(documents, again)


def _kind(codec: str) -> str:
    return codec if codec == "utf_8" else "multi" if codec in _MULTI else "western" if codec in (*_WESTERN, "iso8859_15") else "single"


#: The chains by what kind of encoding was read as what other kind.
FAMILIES: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _w, _t in CHAINS:
    FAMILIES.setdefault((_kind(_w), _kind(_t)), []).append((_w, _t))


def garble(text: str, w: str, t: str) -> str | None:
    """The text written as t and read as w; null if it can't be, or stays what it is."""
    raw = as_bytes(text, t)
    try:
        read = None if raw is None else codecs.charmap_decode(raw, "strict", _CHARACTERS[w])[0] if w in _CHARACTERS else raw.decode(w)
    except UnicodeDecodeError:
        return None
    return None if read == text else read


def garblings(passage: str) -> dict[tuple[str, str], str]:
    """The passage garbled by one chain of every family that can; the hash of the passage says with which to begin."""
    out, begin = {}, zlib.crc32(passage.encode("utf_8", "surrogatepass"))
    for family, chains in FAMILIES.items():
        for k in range(len(chains)):
            read = garble(passage, *chains[(begin + k) % len(chains)])
            if read is not None:
                out[family] = read
                break
    twice = garble(out.get(("western", "utf_8"), ""), "latin_1", "utf_8")
    return out | ({("twice", "utf_8"): twice} if twice else {})


#: Gains are counted by the hundredth of a nat up to this many nats, so that no quantile needs them in one place.
MOST = 100.0


def _measured(judge: Restorer, passages: list[str], times: list[int]) -> pd.DataFrame:
    """How often clean passages (family ""), and those garbled on purpose, gain how much: (family, gain, n)."""
    found: dict[tuple[str, float], int] = {}
    for i in range(0, len(passages), 1_000):
        cases = [[("", p), *((">".join(f), g) for f, g in garblings(p).items())] for p in passages[i : i + 1_000]]
        gains = iter(judge.gains_of([alike(g) for c in cases for _, g in c]))
        for case, n in zip(cases, times[i : i + 1_000]):
            for family, _ in case:
                at = (family, round(min(MOST, next(gains)), 2))
                found[at] = found.get(at, 0) + n
    return pd.DataFrame([(*k, n) for k, n in found.items()], columns=["family", "gain", "n"])


def _quantile(gains: pd.DataFrame, q: float) -> float:
    """The least counted gain that a share q of all does not exceed."""
    gains = gains.sort_values("gain")
    return float(gains["gain"].to_numpy()[np.searchsorted(gains["n"].cumsum().to_numpy(), q * gains["n"].sum())])


def clean_passages(documents: DataFrame) -> DataFrame:
    """(half, passage, n): every passage that isn't ASCII and looks clean by its bytes, digits being alike as in the model, and how many distinct ones it stands for."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suspect = Suspects()
        for rows in batches:
            found = dict.fromkeys((h, p) for text, h in zip(rows["text"], rows["half"]) for p in _SENTENCE.split(_bare(text)) if not p.isascii())
            found = [(h, p.translate(_ALIKE), p) for h, p in found if not suspect(p)]
            yield pd.DataFrame(found, columns=["half", "passage", "as_is"])

    spark = documents.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = documents.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select("text", half(F.col("text")).alias("half"))
    distinct = texts.mapInPandas(cut, "half int, passage string, as_is string").distinct()
    return distinct.groupBy("half", "passage").agg(F.count("*").alias("n")).repartition(tasks, "passage")


def margin_of(spark: SparkSession, documents: DataFrame, halves: list[Model]) -> float:
    """A margin for passages: above what 99 % of those that look clean gain, below what 99 % of those garbled on purpose gain.

    All distinct passages of the corpus count, each judged by the model of the half that it isn't
    in. They are garbled by every family of chains; of families whose gains overlap with those of
    clean passages more than that, none can set the margin. At least 1 nat; what looks clean by
    its bytes may still be garbled, hence no higher share.
    """
    shared = spark.sparkContext.broadcast([_tables(m) for m in halves])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = [Restorer(Model(*tables), 0.0) for tables in shared.value]
        for rows in batches:
            for h, own in rows.groupby("half"):
                yield _measured(judges[1 - h], own["passage"].tolist(), own["n"].tolist())

    gains = clean_passages(documents).mapInPandas(measure, "family string, gain double, n bigint").groupBy("family", "gain").agg(F.sum("n").alias("n")).toPandas()
    by = {family: rows for family, rows in gains.groupby("family")}
    if "" not in by:
        return 3.0
    clean = max(1.0, _quantile(by.pop(""), 0.99))
    least = [_quantile(rows, 0.01) for rows in by.values()]
    return max(1.0, min([clean, *(x for x in least if x > 1.0)]))


def restore(spark: SparkSession, documents: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, garbled, text, chains, whole): one row per row of documents.

    garbled: at least one sentence was read with a wrong encoding. text: with what could be
    restored; whole: nothing of it is lost. Null, empty and pure ASCII texts, and what stands
    between backticks, are never garbled. A replacement character outside of backticks is a
    loss. Rows that repeat are each judged; an empty table gives an empty result. Only the key
    and text are read, so other columns of any name do no harm. The model takes in all texts,
    and the margin is set on all their passages.
    """
    docs = documents.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < 2 * cores:
        docs = docs.repartition(2 * cores)
    *halves, model = train(spark, docs)
    margin = margin_of(spark, docs, halves)
    shared = spark.sparkContext.broadcast((model.tri, model.bi, model.uni, margin))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tri, bi, uni, limit = shared.value
        judge = Restorer(Model(tri, bi, uni), limit)
        for rows in batches:
            done = []
            for texts in _portions([t if isinstance(t, str) else None for t in rows["text"]]):
                judge.weigh(texts)
                done += map(judge.text, texts)
            yield pd.DataFrame({"key": rows["key"], "garbled": [d[0] for d in done], "text": [d[1] for d in done], "chains": [d[2] for d in done], "whole": [d[3] for d in done]})

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInPandas(judge, f"key {kind}, garbled boolean, text string, chains array<string>, whole boolean").withColumnRenamed("key", key)
