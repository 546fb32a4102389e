"""Secret scans: fixed credential patterns, and formats learnt from them as probabilistic automata.

1. One pass over the whole texts finds the base spans (``KINDS``) and the other candidates: maximal runs of
   credential characters, which are all ASCII, whatever other letters touch them, without full stops at the end. The
   least length of a candidate is
   that of the shortest value that a learning kind has, ``CANDIDATE_MIN`` at most.
2. The values of the base spans are labelled credentials. For each kind, up to ``LEARN_MAX`` distinct ones (smallest
   hash first, ``LEARN_LENGTH`` characters at most) build a prefix tree over character classes. Red-blue order merges it
   into a probabilistic automaton: a new state with its compatible sisters, then with the nearest compatible state. Two states are compatible if all that follows them
   is: the remaining lengths of the strings below them (Kolmogorov-Smirnov bound) and the classes at each distance
   (Hoeffding bound, for all cells together), both pooled over every string that passes. So positions stay apart where
   lengths or classes differ, although most nodes of the tree hold one string only.
3. Candidates outside base spans that no learnt kind explains give the automaton of ordinary tokens in the same way.
   At first a kind explains what it makes likelier than ``background`` does, a model of the single string that no other
   candidate enters. Then it explains what it makes likelier than the last ordinary model does, ``ROUNDS`` times.
   So unlabelled credentials do not enter that automaton, however large their share is. Where under ``LEARN_MAX``
   ordinary candidates remain, shorter runs are taken too.
4. Every candidate outside the base spans is scored: the log likelihood under a kind's automaton over that of ordinary
   tokens, a mixture of their automaton and ``background`` by the number of strings learnt from. A string that ends
   where no labelled string of its kind can end has no likelihood. From ``LOG_ODDS`` on, times ``1 + DOUBT / strings
   learnt from``, the string becomes a span ``format_<kind>`` of the most likely kind. So a kind with few labelled
   strings asks for more evidence, and none is left out.

The texts are scanned again for the scores: storing every run of six characters would copy most of each text.

``LEARN_MAX`` bounds what each automaton learns from; every text is scanned and every candidate scored.

Defined results: a null text counts as empty; rows come one for one, repeated or null ids included; texts without a
span have empty lists. Only the id and text columns are read; ``redact`` keeps all columns.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import SLICE_ROWS, map_rows, stored

# Fixed by the contract: the base patterns, the least length of what they find, the order of the kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: No labelled value is shorter: assigned values have 6 characters, the others 20 and 24.
VALUE_MIN = 6
CANDIDATE_MIN = 16
RUN = {n: re.compile(rf"[A-Za-z0-9+/_.=-]{{{n},}}+") for n in range(VALUE_MIN, CANDIDATE_MIN + 1)}
#: Distinct strings that a task remembers, and their greatest length.
SEEN_MAX = 100_000
SEEN_LENGTH = 64
LEARN_MAX = 2000
LEARN_LENGTH = 256
ALPHA = 0.05
LOG_ODDS = 8.0
DOUBT = 4.0
#: Distances from a state up to which what follows is compared; longer rests count as one.
WINDOW = 64
#: Weight, in strings, of the class shares of a whole automaton in each of its states; share of a class never seen.
SHARED = 1.0
NEVER = 1e-3
#: Refits of the ordinary automaton, and how far a kind may be below ``background`` and still explain a candidate.
ROUNDS = 2
MARGIN = 3.0
#: Classes of candidate characters and their sizes.
CLASSES = {c: k for k, group in {
    "0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ",
    "+": "+", "/": "/", "_": "_", ".": ".", "=": "=", "-": "-"}.items() for c in group}
CLASS_SIZE = {k: sum(v == k for v in CLASSES.values()) for k in sorted(set(CLASSES.values()))}
KINDS_OF_CLASS = list(CLASS_SIZE)
CLASS_NUMBER = {c: KINDS_OF_CLASS.index(k) for c, k in CLASSES.items()}


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the value)`` of the base spans, in order of start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, spans: list, least: int) -> list[tuple[int, int, str]]:
    """Candidates of ``least`` characters or more that no base span overlaps."""
    out = []
    for m in RUN[least].finditer(text):
        if not any(s[1] < m.end() and m.start() < s[2] for s in spans):
            run = m.group().rstrip(".")
            if len(run) >= least:
                out.append((m.start(), m.start() + len(run), run))
    return out


class Learner:
    """Merges the prefix tree of some strings; a state is the list of the ``(string, position)`` that pass it."""

    def __init__(self, strings: list[str], alpha: float):
        import numpy as np

        self.n_classes = len(KINDS_OF_CLASS)
        codes = [[CLASS_NUMBER[c] for c in s] for s in sorted(strings)]
        # behind its end a string has the last class, which stands for nothing
        self.codes = np.full((len(codes), max(map(len, codes), default=0) + WINDOW + 1), self.n_classes, np.int8)
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.passes: list[list[tuple[int, int]]] = [[]]
        self.go: list[dict[int, int]] = [{}]
        for i, code in enumerate(codes):
            self.codes[i, :len(code)] = code
            at = 0
            self.passes[0].append((i, 0))
            for j, k in enumerate(code, 1):
                if k not in self.go[at]:
                    self.go[at][k] = len(self.go)
                    self.go.append({})
                    self.passes.append([])
                at = self.go[at][k]
                self.passes[at].append((i, j))
        self.alpha = alpha
        self.length_bound = math.sqrt(0.5 * math.log(2 / alpha))

    def profile(self, passes: list[tuple[int, int]]):
        """Counts of what follows: strings by remaining length, and by class at each distance."""
        import numpy as np

        which, at = np.array(passes).T
        rest = np.bincount(np.minimum(self.sizes[which] - at, WINDOW), minlength=WINDOW + 1)
        ahead = self.codes[which[:, None], at[:, None] + np.arange(WINDOW)]
        cell = np.arange(WINDOW) * (self.n_classes + 1) + ahead
        classes = np.bincount(cell.ravel(), minlength=WINDOW * (self.n_classes + 1)).reshape(WINDOW, -1)[:, :-1]
        return rest, classes.ravel()

    def run(self) -> list[tuple[int, int, dict[str, tuple[int, int]]]]:
        import numpy as np

        red, place = [0], {0: 0}
        rests, classes = ([x] for x in self.profile(self.passes[0]))

        def fold(a: int, b: int) -> None:
            """Adds the tree below ``b`` to the automaton at ``a``."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                self.passes[a] += self.passes[b]
                if a in place:
                    rest, ahead = self.profile(self.passes[b])
                    rests[place[a]] = rests[place[a]] + rest
                    classes[place[a]] = classes[place[a]] + ahead
                for k, child in self.go[b].items():
                    if k in self.go[a]:
                        todo.append((self.go[a][k], child))
                    else:
                        self.go[a][k] = child

        def gaps(rest, ahead, m: int, others: list, n):
            """How far some states' profiles are from one profile, and whether chance explains it."""
            known, held = np.array([x for x, _ in others]), np.array([x for _, x in others])
            apart = known / n[:, None] - rest / m
            classes = np.abs(held / n[:, None] - ahead / m)
            cells = max(1, int(((held > 0) | (ahead > 0)).any(0).sum()))
            chance = math.sqrt(0.5 * math.log(2 * cells / self.alpha)) * (n ** -0.5 + m ** -0.5)
            lengths = np.abs(np.cumsum(apart, axis=1)).max(1) <= self.length_bound * np.sqrt(1 / n + 1 / m)
            return np.abs(apart).sum(1) + classes.sum(1) / WINDOW, lengths & (classes.max(1) <= chance)

        while True:
            r = next((r for r in red if any(c not in place for c in self.go[r].values())), None)
            if r is None:
                break
            # the most frequent new child first takes in those of its sisters that are compatible with it
            new = sorted({c for c in self.go[r].values() if c not in place}, key=lambda c: (-len(self.passes[c]), c))
            child = new[0]
            for sister in new[1:]:
                rest, ahead = self.profile(self.passes[sister])
                n = np.array([len(self.passes[child])])
                if gaps(rest, ahead, len(self.passes[sister]), [self.profile(self.passes[child])], n)[1][0]:
                    fold(child, sister)
                    self.go[r] = {k: child if c == sister else c for k, c in self.go[r].items()}
            rest, ahead = self.profile(self.passes[child])
            n = np.array([len(self.passes[q]) for q in red])
            far, fits = gaps(rest, ahead, len(self.passes[child]), list(zip(rests, classes)), n)
            if fits.any():
                target = red[int(np.where(fits, far, np.inf).argmin())]
                self.go[r] = {k: target if c == child else c for k, c in self.go[r].items()}
                fold(target, child)
            else:
                place[child] = len(red)
                red.append(child)
                rests.append(rest)
                classes.append(ahead)
        out = []
        for q in red:
            steps: dict[int, int] = {}
            ends = 0
            for i, j in self.passes[q]:
                if j == self.sizes[i]:
                    ends += 1
                else:
                    k = int(self.codes[i, j])
                    steps[k] = steps.get(k, 0) + 1
            out.append((len(self.passes[q]), ends, {KINDS_OF_CLASS[k]: (place[self.go[q][k]], n) for k, n in sorted(steps.items())}))
        return out


def learn(strings: list[str], alpha: float = ALPHA) -> dict:
    """Strings -> automaton: ``states`` with visits, ends and ``class -> (next state, count)``, state 0 first; the
    ``shares`` of the classes in all of it; the number ``n`` of strings."""
    states = Learner(strings, alpha).run()
    total = sum(c for _, _, go in states for _, c in go.values())
    seen = {k: sum(go[k][1] for _, _, go in states if k in go) for k in CLASS_SIZE}
    shares = {k: (seen[k] / total if seen[k] else NEVER) if total else NEVER for k in CLASS_SIZE}
    return {"states": states, "shares": shares, "n": len(strings)}


def log_likelihood(automaton: dict, text: str, part: bool = False) -> float:
    """Minus infinity for a string that ends, or goes on, where no learnt string does.

    With ``part`` the string may be cut short or go on: only the classes up to there count."""
    at, out = 0, 0.0
    states, shares = automaton["states"], automaton["shares"]
    for c in text:
        k = CLASSES[c]
        seen, _, go = states[at]
        if not go:
            return out if part else -math.inf
        nxt, n = go.get(k) or (max(go.values(), key=lambda x: x[1])[0], 0)
        out += math.log((n + SHARED * shares[k]) / (seen + SHARED)) - math.log(CLASS_SIZE[k])
        at = nxt
    seen, ends, _ = states[at]
    if part:
        return out
    return out + math.log(ends / (seen + SHARED)) if ends else -math.inf


def background(text: str) -> float:
    """Log likelihood under class counts that start even and follow the string itself (Krichevsky-Trofimov).

    Its length has the probability 1 / (length * (length + 1)), which sums to 1 over all lengths."""
    counts, out = dict.fromkeys(CLASS_SIZE, 0.5), -math.log(len(text) * (len(text) + 1))
    total = 0.5 * len(counts)
    for c in text:
        k = CLASSES[c]
        out += math.log(counts[k] / (total * CLASS_SIZE[k]))
        counts[k] += 1
        total += 1
    return out


def best_kind(model: dict, text: str, part: bool = False) -> tuple[float, str]:
    """The log likelihood under the most likely learnt kind, and the kind."""
    return max((log_likelihood(a, text, part), k) for k, a in sorted(model["kinds"].items()))


def plain_likelihood(model: dict, text: str) -> float:
    """Log likelihood as an ordinary token: their automaton and ``background``, mixed by the strings learnt from."""
    alone = background(text)
    if not model["plain"]:
        return alone
    n = model["plain"]["n"]
    learnt = log_likelihood(model["plain"], text) + math.log(n / (n + DOUBT))
    alone += math.log(DOUBT / (n + DOUBT))
    high, low = max(learnt, alone), min(learnt, alone)
    return high + math.log1p(math.exp(low - high))


def ordinary(model: dict, text: str) -> bool:
    """No learnt kind explains the string, nor a string that it is a cut or longer form of (these are neither)."""
    return best_kind(model, text, part=True)[0] <= plain_likelihood(model, text) - (0.0 if model["plain"] else MARGIN)


def verdict(model: dict, text: str) -> tuple[str | None, float]:
    """The most likely learnt kind and its log odds against ordinary tokens; None below what the kind asks for."""
    if not model["kinds"]:
        return None, 0.0
    seen, kind = best_kind(model, text)
    odds = seen - plain_likelihood(model, text)
    return (kind if odds >= LOG_ODDS * (1 + DOUBT / model["kinds"][kind]["n"]) else None), odds


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The labelled values ``labelled`` of each row, and the ``candidates`` of any length that its task has not seen."""
    seen: set[str] = set()

    def row(t):
        t = t or ""
        spans = base_spans(t)
        new = {c[2] for c in candidates(t, spans, VALUE_MIN)} - seen
        if len(seen) > SEEN_MAX:
            seen.clear()
        seen.update(x for x in new if len(x) <= SEEN_LENGTH)
        return [(s[0], t[s[3]:s[2]]) for s in spans], list(new)

    return map_rows(df.select(F.col(text).alias("_text")), row,
                    "labelled array<struct<kind:string,text:string>>, candidates array<string>")


def fit(scanned: DataFrame, learn_max: int = LEARN_MAX) -> dict:
    """Automata of the labelled kinds and of ordinary tokens, from a scan; ``learn_max`` strings of each at most."""
    got = (scanned.select(F.explode("labelled").alias("x")).select("x.kind", F.regexp_replace("x.text", "[.]+$", "").alias("text"))
           .where(F.length("text").between(1, LEARN_LENGTH)).distinct())
    rows = None
    for kind in KINDS:
        part = sample(got.where(F.col("kind") == kind), learn_max)
        rows = part if rows is None else rows.union(part)
    strings: dict[str, list[str]] = {}
    for r in rows.collect():
        strings.setdefault(r.kind, []).append(r.text)
    model = {"plain": None, "kinds": {k: learn(v) for k, v in strings.items()}, "least": CANDIDATE_MIN}
    if not model["kinds"]:
        return model
    shortest = got.agg(F.min(F.length("text"))).first()[0]
    model["least"] = max(VALUE_MIN, min(CANDIDATE_MIN, shortest))
    runs = scanned.select(F.explode("candidates").alias("text")).where(F.length("text") <= LEARN_LENGTH)
    others = stored(runs.where(F.length("text") >= model["least"]).distinct())
    short = None
    for _ in range(1 + ROUNDS):
        rest = [r.text for r in unexplained(others, model, learn_max).collect()]
        if len(rest) < learn_max:      # the shorter ones too
            short = short or stored(runs.where(F.length("text") < model["least"]).distinct())
            rest += [r.text for r in unexplained(short, model, learn_max - len(rest)).collect()]
        if rest:
            model = model | {"plain": learn(rest)}
    return model


def sample(strings: DataFrame, n: int) -> DataFrame:
    return strings.orderBy(F.xxhash64("text"), "text").limit(n)


def unexplained(strings: DataFrame, model: dict, n: int) -> DataFrame:
    """The ``n`` rows of ``text`` of smallest hash that no learnt kind explains.

    A task hands on its own ``n`` smallest. It does not score a string above ``n`` that it already has, as such a
    string is not among the smallest.
    """
    def run(batches):
        import pyarrow as pa

        least: list[tuple[int, str]] = []
        for b in batches:
            new = zip(b.column("h").to_pylist(), b.column("text").to_pylist())
            full = len(least) == n
            least += [x for x in new if not (full and x > least[-1]) and ordinary(model, x[1])]
            least = sorted(least)[:n]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in least], pa.int64()),
                                          pa.array([t for _, t in least], pa.string())], names=["h", "text"])

    hashed = strings.select(F.xxhash64("text").alias("h"), "text")
    return hashed.mapInArrow(run, "h bigint, text string").orderBy("h", "text").limit(n).select("text")


def all_spans(model: dict, text: str, known: dict) -> tuple[list, list[tuple[str, int, int]]]:
    """Base spans of a text, and these with the learnt ones in order of start, base kinds first.

    ``known`` keeps the kinds of the strings seen."""
    spans = base_spans(text)
    base = [(s[0], s[1], s[2]) for s in spans]
    out = list(base)
    if not model["kinds"]:
        return base, out
    for start, stop, x in candidates(text, spans, model["least"]):
        if x in known:
            kind = known[x]
        else:
            kind = verdict(model, x)[0]
            if len(x) <= SEEN_LENGTH:
                if len(known) > SEEN_MAX:
                    known.clear()
                known[x] = kind
        if kind:
            out.append((f"format_{kind}", start, stop))
    return base, sorted(out, key=lambda s: (s[1], (KINDS.index(s[0]) if s[0] in KINDS else len(KINDS)), s[0], s[2]))


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``found``: the base spans and all spans as ``(kind, start, stop)`` in code points."""
    model = fit(stored(scan(df, text)))
    kind = df.schema["doc_id"].dataType.simpleString()
    known: dict[str, str | None] = {}

    def row(t, doc_id):
        return doc_id, *all_spans(model, t or "", known)

    span = "array<struct<kind:string,start:int,stop:int>>"
    return map_rows(df.select(F.col(text).alias("_text"), "doc_id"), row, f"doc_id {kind}, base {span}, found {span}")


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with every span replaced by ``mark``; an integer ``n_chars`` follows the new length.

    Rows and columns stay. Formats are learnt from one scan, and the texts are scanned again while they are rewritten,
    so no text is stored or shuffled.
    """
    model = fit(stored(scan(df, text)))
    names = df.columns
    known: dict[str, str | None] = {}

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for _, start, stop in all_spans(model, t, known)[1]:
            if start >= at:
                out += [t[at:start], mark]
            at = max(at, stop)
        return "".join([*out, t[at:]]) if out else t

    def rewritten(b):
        import pyarrow as pa
        import pyarrow.compute as pc

        i = names.index(text)
        new = pa.array([clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type)
        if "n_chars" in names and pa.types.is_integer(b.schema.field(names.index("n_chars")).type):
            j = names.index("n_chars")
            changed = pc.fill_null(pc.not_equal(new, b.column(i)), False)
            size = pc.utf8_length(new).cast(b.schema.field(j).type)
            b = b.set_column(j, b.schema.field(j), pc.if_else(changed, size, b.column(j)))
        return b.set_column(i, b.schema.field(i), new)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                yield rewritten(b.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, df.schema)


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts and span lists per document, as ``doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans``."""
    found = find_secrets(df, text)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        (F.size("found") - F.size("base")).cast("long").alias("n_format"),
                        F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("found").alias("spans"))
