"""Language identification by cross-parsing entropy.

For each labelled language a suffix automaton is built of a bounded sample of its text. A text is
parsed against each automaton into longest matches; a language's code length is the number of
phrases times the bits of a position in its sample, with LITERAL bits more for a phrase that is a
letter which the sample does not have, and the shortest code wins. Texts are parsed
whole. To parse many places at once, a text is cut into lanes of LANE letters, each parsed from its
own begin; then each lane is parsed again from the state in which the lane before it ended, until
both parses begin a phrase at one letter, from where they agree. What has not met by the end of its
lane is parsed letter by letter to the end of the text, so the counts are those of one parse.

The sample is the SAMPLE_DOCS distinct texts with the least hashes of each language, and at most
SAMPLE_CHARS letters of them, shared out evenly so that one long document can't fill it. It is all
that is broadcast, at most SHARE times as much is collected, and each worker builds the automata
from it once, as double arrays of about as many cells as the automata have arcs.

Edge cases: text that is null or has no letter -> `und`, score 0. Every letter of the samples has a
code of its own; a letter that a sample does not have is a phrase of its own. Equal code lengths go
to the language with more labelled rows, then by name. A table without a labelled row -> all `und`;
a language whose labelled texts have no letter is not learned. A null doc_id counts as the text "".
Repeated rows are answered one by one. Extra columns are ignored by `digest` and kept by `accepted`,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, held, prepare

UNKNOWN = "und"
#: Bounds of the sample for each language: documents, and letters with word gaps.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 40_000
#: Even parts of a language's letters that one document may give.
SHARE = 8
#: Bits of a letter that a sample does not have, beside those of its phrase.
LITERAL = 20
#: Letters of a lane, and codes gathered before they are parsed.
LANE, GATHER = 512, 1 << 19
#: Places tried for the arcs of a state before the search moves on for good.
TRIES = 16
#: A text of at least this many letters whose mean phrase is shorter is no known language.
LEAST_LETTERS, LEAST_PHRASE = 20, 1.6


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, seed: int = 11) -> list[tuple[str, int, str]]:
    """(language, labelled rows, text) for each language, by falling rows, then name.

    Texts are drawn by their hash and taken once, so copies don't crowd out others, however many
    rows hold them. A document gives at most SHARE times its even part of the letters.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "text")
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return []
    drawn = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("text", F.lit(seed)))
    chosen = drawn.select("lang", "draw").distinct()
    for part in (["lang", F.pmod("draw", F.lit(64))], ["lang"]):  # in two steps, so that a common language is no one task's
        chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("draw"))).where(F.col("nth") <= SAMPLE_DOCS)
    found: dict[str, dict] = {k: {} for k in counts}
    for lang, draw, _ in chosen.collect():
        found[lang][draw] = ""
    if not any(found.values()):
        return []
    most = {k: min(SAMPLE_CHARS, SHARE * SAMPLE_CHARS // len(v)) for k, v in found.items() if v}
    # At most SAMPLE_DOCS rows for each language.
    wanted = docs.sparkSession.createDataFrame([(k, draw, most[k]) for k, v in found.items() for draw in v], "lang string, draw long, most int")
    texts = drawn.join(F.broadcast(wanted), ["lang", "draw"]).select("lang", "draw", F.substring("text", F.lit(1), F.col("most")).alias("text"))
    for lang, draw, text in texts.groupBy("lang", "draw").agg(F.min("text").alias("text")).collect():
        found[lang][draw] = plain(text)
    out = []
    for lang, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        own = [t for _, t in sorted(found[lang].items()) if t.strip()]
        part = even_part([len(t) for t in own], SAMPLE_CHARS)
        if own:
            out.append((lang, n, "".join(t[:part] for t in own)))
    return out


def even_part(lengths: list[int], budget: int) -> int:
    """The longest part such that texts cut to it fit the budget together."""
    left, part = budget, budget
    for i, n in enumerate(sorted(lengths)):
        part = left // (len(lengths) - i)
        if n > part:
            return part
        left -= n
    return max([part, *lengths])


def plain(text: str) -> str:
    """Lower-case letters, each run of other characters as one blank, blanks at both ends."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The arcs of each state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Arcs:
    """Arcs in a double array: that of state s by code c is in cell base[s] + c, if the cell's owner is s."""

    def __init__(self, arcs: list[dict[int, int]], width: int):
        self.dead = len(arcs)  # a state without arcs
        room = sum(map(len, arcs)) + 2 * width
        used = bytearray(room)
        self.base = np.full(len(arcs) + 1, width, np.int32)
        owner, target = [-1] * room, [0] * room
        low = start = width
        for s in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
            if not arcs[s]:
                break
            codes = sorted(arcs[s])
            if len(codes) == 1:  # states of one arc fill the gaps that the others leave
                at = low = used.find(0, low)
            else:
                at = start = used.find(0, start)
            for tried in count():
                if tried == TRIES:
                    start = at
                if at < 0 or at + width >= len(used):
                    at = at if at >= 0 else len(used)
                    more = len(used)
                    used += bytes(more)
                    owner += [-1] * more
                    target += [0] * more
                if not any(used[at + c - codes[0]] for c in codes[1:]):
                    break
                at = used.find(0, at + 1)
            self.base[s] = at - codes[0]
            for c, t in arcs[s].items():
                cell = at - codes[0] + c
                used[cell], owner[cell], target[cell] = 1, s, t
        last = max((i for i, o in enumerate(owner) if o >= 0), default=0)
        self.owner = np.array(owner[: max(last + 1, int(self.base.max()) + width + 1)], np.int32)
        self.target = np.array(target[: len(self.owner)], np.int32)
        # Where a phrase that begins with a code leads to; dead if no phrase does.
        self.first = np.full(width + 1, self.dead, np.int32)
        for c, t in arcs[0].items():
            self.first[c] = t

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after code, and whether a new phrase begins with it."""
        cell = self.base[state] + code
        new = self.owner[cell] != state
        return np.where(new, self.first[code], self.target[cell]), new

    def count(self, state: int, codes: np.ndarray) -> int:
        """Phrases that begin in codes, parsed one by one from `state`."""
        base, owner, target, first, n = *map(memoryview, (self.base, self.owner, self.target, self.first)), 0
        for c in codes.tolist():
            cell = base[state] + c
            if owner[cell] == state:
                state = target[cell]
            else:
                state = first[c]
                n += 1
        return n


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


class Parser:
    """The automata of all languages, and the parse of many lanes at once."""

    def __init__(self, samples: list[tuple[str, int, str]]):
        self.langs = [s[0] for s in samples]
        letters = sorted(set("".join(s[2] for s in samples)) - {" "})
        self.other = len(letters) + 1  # 0 is the blank, this any letter of no sample
        self.code = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        self.points = np.where(_letters(), self.other, 0).astype(np.int32)
        self.points[np.array([ord(c) for c in letters], np.int64)] = np.arange(1, self.other)
        # Samples of nearly one size cost the same, so that equal phrase counts are a tie.
        self.bits = [round(math.log2(max(2, len(s[2]))), 2) for s in samples]
        self.arcs = [Arcs(suffix_automaton([self.code[c] for c in text]), self.other + 1) for _, _, text in samples]

    def codes(self, text: str) -> np.ndarray:
        out = self.points[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        out = np.concatenate([out, np.zeros(1, np.int32)])
        return out[(out != 0) | (np.concatenate([np.zeros(1, np.int32), out[:-1]]) != 0)]

    def unseen(self, texts: list[np.ndarray]) -> np.ndarray:
        """Letters of each text (codes) that a language's sample does not have."""
        owner, flat = np.repeat(np.arange(len(texts)), [len(x) for x in texts]), np.concatenate(texts)
        return np.stack([np.bincount(owner, a.first[flat] == a.dead, len(texts)) for a in self.arcs], axis=1)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (codes) by language."""
        out = np.zeros((len(texts), len(self.arcs)), np.int64)
        starts = [(t, i) for t, x in enumerate(texts) for i in range(0, len(x), LANE)]
        if not starts:
            return out
        owner, begin = np.array(starts).T
        size = np.minimum(LANE, np.array([len(x) for x in texts])[owner] - begin)
        order = np.lexsort((np.arange(len(size)), -size))  # the longest lanes first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        lanes = np.zeros((LANE, len(order)), np.int32)
        for k, o in enumerate(order.tolist()):
            lanes[: size[o], k] = texts[owner[o]][begin[o] : begin[o] + size[o]]
        wide = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")  # lanes longer than a step
        later = np.flatnonzero(begin > 0)  # each follows the lane before it
        for lang, arcs in enumerate(self.arcs):
            state = np.full(len(order), arcs.dead, np.int32)
            new = np.zeros(lanes.shape, np.bool_)
            for step, n in enumerate(wide.tolist()):
                state[:n], new[step, :n] = arcs.step(state[:n], lanes[step, :n])
            total = new.sum(0)
            # Again from where the lane before ended, until both parses begin a phrase together.
            mine = place[later]
            own, lost = state[place[later - 1]], np.zeros(len(later), np.int64)
            live, met = np.arange(len(later)), np.zeros(len(later), np.bool_)
            for step in range(int(size[later].max()) if len(later) else 0):
                live = live[size[later[live]] > step]
                if not len(live):
                    break
                old = new[step, mine[live]]
                own[live], begins = arcs.step(own[live], lanes[step, mine[live]])
                lost[live] += begins.astype(np.int64) - old
                met[live] = begins & old
                live = live[~(begins & old)]
            total[mine] += lost
            out[:, lang] = np.bincount(owner[order], total, len(texts))
            apart = ~met & (own != state[mine]) & np.append(begin, 0)[later + 1].astype(np.bool_)
            for t in np.unique(owner[later[apart]]).tolist():
                out[t, lang] = arcs.count(arcs.dead, texts[t])
        return out


def parser(samples: list[tuple[str, int, str]]) -> Parser:
    """One for each worker process and sample."""
    return held("langid" + hashlib.sha256(repr(samples).encode()).hexdigest(), lambda: Parser(samples))


def predictions(texts: list[str | None], own: Parser) -> list[tuple[str, float, float]]:
    """Language, score and mean phrase length of each text."""
    out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    group: list[tuple[int, np.ndarray]] = []
    gathered = 0

    def parse() -> None:
        codes = [c for _, c in group]
        phrases = own.phrases(codes)
        bits = phrases * np.array(own.bits) + own.unseen(codes) * LITERAL
        for (i, c), n, b in zip(group, phrases, bits, strict=True):
            best = int(b.argmin())
            out[i] = (own.langs[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()), len(c) / int(n[best]))

    for i, text in enumerate(texts):
        c = own.codes(text) if text and own.arcs else np.zeros(0, np.int32)
        if not c.any():
            continue
        group.append((i, c))
        gathered += len(c)
        if gathered >= GATHER:
            parse()
            group, gathered = [], 0
    if group:
        parse()
    return out


def _identified(docs: DataFrame, samples: list[tuple[str, int, str]]) -> tuple[DataFrame, str]:
    """docs with one struct column more, of a name that docs doesn't have: lang_pred, score and phrase."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(samples)
    name, kept, at = free(docs, "language"), docs.columns, docs.columns.index("text")
    fields = [("lang_pred", pa.string()), ("score", pa.float64()), ("phrase", pa.float64())]
    schema = docs.withColumn(name, F.lit(None).cast("struct<lang_pred:string,score:double,phrase:double>")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for batch in batches:
            found = predictions(batch.column(at).to_pylist(), own)
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            made = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*kept, name])

    return docs.mapInArrow(work, schema), name


def identify(docs: DataFrame, samples: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """docs with lang_pred, score and phrase (mean phrase length) in place of columns of these names; all others stay."""
    new = ["lang_pred", "score", "phrase"]
    found, name = _identified(docs, sample(docs) if samples is None else samples)
    return found.select(*[c for c in docs.columns if c not in new], *[F.col(name)[n].alias(n) for n in new])


def accepted(docs: DataFrame, samples: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """The rows of docs in a known language: texts without a letter, and texts that no language's sample parses, go."""
    found, name = _identified(docs, sample(docs) if samples is None else samples)
    known = F.col(name)["lang_pred"] != UNKNOWN
    readable = (F.length("text") < LEAST_LETTERS) | (F.col(name)["phrase"] >= LEAST_PHRASE)
    return found.where(known & readable).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op4. Only doc_id and text reach the predictor."""
    samples = sample(docs)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), samples)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
