"""Variant spellings of names typed by people: metric-space partitioning, exact radius joins, then a check of the parts.

Names are compared inside blocks of rows that agree in what a registrant keeps. The metric is the Levenshtein distance of
the distinctive word (a surname, an organisation's own name), for blocking and for linking. A block that one task can hold
is one cell, joined exactly by that task. Larger blocks are partitioned by pivots: each name goes to its nearest pivot and,
by the triangle inequality, to every pivot that is at most twice the radius further away, so any two names within the
radius share the cell of one of them; cells that are still large are partitioned again. Where pivots hardly part the names
of a cell, it is cut into shares instead, so that levels do not multiply the rows by the number of pivots. The pairs within
the radius are checked part by part (given names, nicknames, initials, kinds of business), and linked spellings are
closed over.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.session import durable
from auditloom.functions.text import fold, is_null_cell
from auditloom.llm.canonical_map import CanonicalList, edits, skeleton

_SPLIT = re.compile(r"[\W_]+")

# Words that are no part of who somebody is.
TITLES = frozenset(("dr", "prof", "professor", "mr", "mrs", "ms", "miss", "mx", "sir", "dame", "rev", "jr", "sr"))
PARTICLES = frozenset(("al", "el", "van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "bin", "ibn", "ten", "ter"))
FILLERS = frozenset(("the", "and", "of", "for"))

# The legal forms of organisations and their short spellings.
LEGAL_FORMS = frozenset((
    "ltd", "limited", "inc", "incorporated", "co", "company", "corp", "corporation", "bros", "brothers", "sons", "son",
    "assoc", "assn", "association", "associates", "coop", "cooperative", "op", "partnership", "pship", "ptnrs", "partners",
    "llp", "llc", "plc", "gmbh", "grp", "group", "holdings", "trust", "society", "soc", "ptnrship", "partnershp",
))

# Words for kinds of business.
BUSINESS = frozenset((
    "haulage", "stationery", "catering", "roofing", "chandlery", "printing", "textiles", "joinery", "brewing",
    "engineering", "works", "dental", "bakery", "scaffolding", "freight", "practice", "plumbing", "logistics",
    "international", "veterinary", "management", "centre", "center", "property", "services", "foundry", "nurseries",
    "nursery", "brewery", "print", "textile", "bakers", "builders", "garage", "farm", "farms", "school", "clinic",
))


# Usual short forms of the words above.
_SHORT_BUSINESS = frozenset(("intl", "svcs", "svc", "mgmt", "vet", "eng", "engg", "ctr", "pract", "prop"))
#: Kinds of business by their first and by their last three letters, one of which one wrong letter leaves as it is.
_BY_END = {end: tuple(b for b in BUSINESS if len(b) >= 6 and end in (b[:3], b[-3:])) for end in {e for b in BUSINESS for e in (b[:3], b[-3:])}}


def plain(text: str) -> str:
    """Lower case without accents."""
    lowered = text.lower()
    if lowered.isascii():
        return lowered
    decomposed = unicodedata.normalize("NFKD", lowered)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch))


def name_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(plain(text).replace("'", "").replace("’", "")) if w]


@dataclass(frozen=True)
class Name:
    """A parsed name: its distinctive word, then given names in order (persons) or kinds of business (organisations)."""

    own: str
    rest: tuple[str, ...]
    organisation: bool
    text: str


class NameReader:
    """Parses names and compares them, with what is known of given names and of the values of other fields."""

    def __init__(self, common: set[str], short_forms: list[tuple[str, str]], other_fields: list[list[tuple[str, str]]]):
        self.shorts: dict[str, set[str]] = {}
        for full, short in short_forms:
            self.shorts.setdefault(plain(short), set()).add(plain(full))
        fulls = {f for fs in self.shorts.values() for f in fs}
        given = {plain(w) for w in common} - TITLES - PARTICLES - FILLERS - LEGAL_FORMS - BUSINESS
        self.given = {w for w in given | fulls if len(w) > 1}
        self.known = self.given | set(self.shorts)
        self.initials = {w: {w[0]} for w in self.known}
        for short, wholes in self.shorts.items():
            for whole in wholes:
                self.initials.setdefault(whole, {whole[0]}).add(short[0])
        self.openings = {w[:k] for w in self.given for k in range(3, len(w))}
        self.by_end: dict[str, list[str]] = {}
        for w in self.given:
            if len(w) >= 4:
                for end in (w[:2], w[-2:]):
                    self.by_end.setdefault(end, []).append(w)
        self.by_length = sorted(self.known, key=len, reverse=True)
        self.others = [CanonicalList(entries) for entries in other_fields]
        self._fitting: dict[tuple[str, str], bool] = {}

    def read(self, text: str) -> Name | None:
        """The parsed name, or None if the cell holds a value of one of the other fields or no letter or digit."""
        words = name_words(text)
        flat = _SPLIT.sub("", text.lower())
        if not words or not flat or any(flat in o.whole for o in self.others):
            return None
        if not any(w in self.known or w in LEGAL_FORMS or w in BUSINESS for w in words) and any(o.holds(text) for o in self.others):
            return None
        return self._parsed(words)

    def _segmented(self, text: str) -> list[str] | None:
        """The words of a name written without breaks, or with false ones, by a known given name at either end."""
        for name in self.by_length:
            if len(name) >= 3 and len(text) - len(name) >= 4:
                if text.startswith(name):
                    return [name, text[len(name) :]]
                if text.endswith(name):
                    return [text[: -len(name)], name]
        return None

    def _given_like(self, word: str) -> bool:
        """A given name, a short form of one, or one mistyped."""
        if word in self.known or word in self.openings:
            return True
        if len(word) < 4:
            return False
        most = 1 if len(word) < 7 else 2
        near = {*self.by_end.get(word[:2], ()), *self.by_end.get(word[-2:], ())}
        return any(edits(word, g, most) <= most for g in near if abs(len(g) - len(word)) <= most)

    def parse(self, text: str) -> Name:
        return self._parsed(name_words(text))

    def _parsed(self, words: list[str]) -> Name:
        bare = [w for w in words if w not in TITLES and w not in FILLERS]
        if any(w in BUSINESS or self._business_like(w) for w in bare) or any(w in LEGAL_FORMS and w not in ("co", "op", "son") for w in bare):
            left = [w for w in bare if w not in LEGAL_FORMS]
            own = [w for w in left if w not in BUSINESS and not self._business_like(w)] or left or bare
            first = max(own, key=len)
            rest = tuple(w for w in left if w != first)
            return Name(first, rest, True, "".join(words))
        left = [w for w in bare if w not in PARTICLES] or bare
        if len(left) > 2:
            left = [w for w in left if not self._particle_like(w)]
        joined = "".join(left)
        if len(left) == 1 or not any(w in self.known or len(w) == 1 for w in left) and not any(map(self._given_like, left)):
            left = self._segmented(joined) or left
        rare = [w for w in left if w not in self.known and len(w) > 2]
        if len(rare) > 1:
            rare = [w for w in rare if not self._given_like(w)] or rare
        if 1 < len(rare) < len(left):
            # Beside a given name: a surname with a break in it, put there on purpose or not.
            ends = [i for i, w in enumerate(left) if w in rare]
            if ends == list(range(ends[0], ends[-1] + 1)):
                left = [*left[: ends[0]], "".join(rare), *left[ends[-1] + 1 :]]
                rare = ["".join(rare)]
        rare = rare or [w for w in left if len(w) > 1] or left or [joined]
        own = max(rare, key=len)
        rest = list(left)
        if own in rest:
            rest.reverse()
            rest.remove(own)
            rest.reverse()
        return Name(own, tuple(rest), False, "".join(words))

    @staticmethod
    def _business_like(word: str) -> bool:
        """A mistyped or shortened kind of business."""
        if word in _SHORT_BUSINESS:
            return True
        return len(word) >= 5 and any(edits(word, b, 1) <= 1 for b in {*_BY_END.get(word[:3], ()), *_BY_END.get(word[-3:], ())} if abs(len(b) - len(word)) <= 1)

    def _particle_like(self, word: str) -> bool:
        most = 1 if len(word) < 5 else 2
        return 3 <= len(word) <= 5 and word not in self.known and word not in self.openings and any(edits(word, p, most) <= most for p in ("van", "von", "der"))

    def _same_word(self, a: str, b: str) -> bool:
        if a == b:
            return True
        n = min(len(a), len(b))
        most = 2 if n >= 5 else 1
        return n >= 4 and edits(a, b, most) <= most

    def _given(self, a: str, b: str) -> int:
        """2: the same given name, 1: an initial of it, 0: another."""
        if a == b:
            return 2
        if len(a) == 1 or len(b) == 1:
            return 1 if self.initials.get(a, {a[0]}) & self.initials.get(b, {b[0]}) else 0
        fa, fb = self.shorts.get(a, set()) | {a}, self.shorts.get(b, set()) | {b}
        if fa & fb:
            return 2
        if a in self.given and b in self.given:
            return 0
        short, long = sorted((a, b), key=len)
        if long in self.given and len(short) >= 2 and (long.startswith(short) or len(short) >= 3 and short[:2] == long[:2] and _subsequence(short, long)):
            return 2
        for x, ys in ((a, fb), (b, fa)):
            if any(self._same_word(x, y) for y in ys):
                return 2
        # A short form of a mistyped name.
        if 3 <= len(short) <= 5 and len(long) >= 5 and short[:2] == long[:2] and _subsequence(short, long):
            return 2
        return 0

    def given_fits(self, a: str, b: str) -> bool:
        """Whether two first given names may be those of one person; none fits any. Pairs come often, so they are kept."""
        fits = self._fitting.get((a, b))
        if fits is None:
            if len(self._fitting) >= 1 << 19:
                self._fitting.clear()
            fits = self._fitting[a, b] = not a or not b or self._given(a, b) != 0
        return fits

    def compare(self, a: Name, b: Name) -> int:
        """2: spellings of one registrant; 1 or -1: so if nobody else fits the first or second, which has only an initial
        for its given name, or none; 0: of two registrants."""
        if a.organisation != b.organisation or not within(a.own, b.own):
            return 0
        if a.organisation:
            return 2 if self._same_business(a.rest, b.rest) else 0
        if not a.rest or not b.rest:
            return 2 if a.rest == b.rest else 1 if not a.rest else -1
        first = self._given(a.rest[0], b.rest[0])
        if not first:
            return 0
        for x, y in zip(a.rest[1:], b.rest[1:], strict=False):
            if not self._given(x, y):
                return 0
        return first if first != 1 else 1 if len(a.rest[0]) == 1 else -1

    def _same_business(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        if not a or not b:
            return False
        short, long = sorted((a, b), key=len)
        left = list(long)
        for w in short:
            hit = next((v for v in left if self._same_kind(w, v)), None)
            if hit is None:
                return False
            left.remove(hit)
        return not left

    def _same_kind(self, a: str, b: str) -> bool:
        if self._same_word(a, b):
            return True
        short, long = sorted((a, b), key=len)
        if len(short) >= 3 and (long.startswith(short) or skeleton(long).startswith(skeleton(short)) and short[:2] == long[:2]):
            return True
        if len(short) >= 3 and short[0] == long[0] and _subsequence(short, long) and short[-1] == long[-1]:
            return True
        return len(short) >= 6 and short[:5] == long[:5] and abs(len(a) - len(b)) <= 3


def distance(a: str, b: str) -> int:
    """Levenshtein distance, one column of the table as bits of one number."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for ch in b:
        match = at.get(ch, 0)
        level = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(level | up) & full, up & level
        if rise & last:
            d += 1
        elif fall & last:
            d -= 1
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(level | rise)) & full, rise & level
    return d


#: Pairs that a task hands on at once.
_PAIRS = 1 << 18

#: The largest distance of distinctive words that may be spellings of each other; the radius of the joins.
RADIUS = 4


def radius_of(n: int) -> int:
    """The distance allowed by the length of the shorter word: a swap of letters is two edits."""
    return 2 if n < 5 else 3 if n < 8 else RADIUS


def within(a: str, b: str) -> bool:
    most = radius_of(min(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def _subsequence(short: str, long: str) -> bool:
    letters = iter(long)
    return all(ch in letters for ch in short)


def common_words(names: DataFrame, share: float = 0.0015, least: int = 5) -> set[str]:
    """Words in at least a share of the distinct spellings: given names, titles, kinds of business. A set of fewer than
    (words in a name) / share words, whatever the table's size."""
    spelled = names.select(F.lower("name").alias("name")).distinct()
    # A blank stands for the spelling itself, so that one pass counts the words and the spellings.
    words = F.filter(F.array_distinct(F.split("name", r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 1)
    counted = durable(spelled.select(F.explode(F.array_append(words, F.lit(" "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    total = counted.filter("word = ' '").first()
    return {r["word"] for r in counted.filter((F.col("n") >= share * (total["n"] if total else 0)) & (F.col("word") != " ")).collect()}


def spellings(names: DataFrame) -> DataFrame:
    """(block, f, name, size) of the blocks with two folded spellings or more; f is a 64-bit hash of the folded spelling,
    name the most telling of its written forms, size the number of spellings of the block."""
    odd = F.regexp_count("name", F.lit(r"[^\p{L}\p{N} ]"))
    words = F.regexp_count("name", F.lit(r"[^\s]+"))
    best = F.struct((words > 1).alias("spaced"), (-odd).alias("odd"), (-words).alias("words"), F.col("name"))
    one = names.groupBy("block", "f").agg(F.max(best)["name"].alias("name"))
    sizes = one.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return one.join(sizes, "block")


def cells(parsed: DataFrame, radius: int, cell_size: int, levels: int = 3) -> DataFrame:
    """The names with ``cell``, for each cell they are compared in, and ``home``, true in the nearest one.

    Blocks of at most ``cell_size`` names are one cell. A larger block gets one pivot for every half cell, at most 64 at a
    time, chosen by hash; the triangle inequality decides where a name is replicated. Cells that are still larger are
    partitioned in turn, up to ``levels`` times; what is left after that is one cell, whatever its size. A cell whose names
    would come into more than ``_COPIES`` cells each is cut into shares instead and is then done.
    """
    open_ = parsed.withColumns({"cell": F.col("block"), "home": F.lit(True)})
    done = None
    for level in range(levels + 1):
        small = open_.filter(F.col("size") <= cell_size) if level < levels else open_
        done = small if done is None else done.unionByName(small)
        if level == levels:
            return done
        big = open_.filter(F.col("size") > cell_size)
        if level and not big.limit(1).count():
            return done
        open_ = durable(_partitioned(big, radius, cell_size, level))
    return done


#: New cells that a name may come into on average, and the names of a share where pivots would bring it into more.
_COPIES, _SHARE = 3, 32_768


def _partitioned(big: DataFrame, radius: int, cell_size: int, level: int) -> DataFrame:
    """One level of pivots, with the size of the new cells; a name is at home where it was and is nearest.

    Where pivots hardly part the names, which one in sixteen of them tells, the cell is cut into shares by ``f``, and every
    two shares are compared in a cell of theirs, which is home to the names of the lesser one. The size of such cells is
    given as 0: they are done.
    """
    wanted = F.least(F.lit(64), F.ceil(F.col("size") / (cell_size / 2))).cast("int")
    order = F.xxhash64("own", F.lit(17 + level))
    # The names with the smallest hashes of a cell are its pivots; the candidates are thinned before they are gathered.
    candidate = F.pmod(order, F.col("size")) < 4 * wanted
    pivots = big.filter(candidate).groupBy("cell").agg(F.slice(F.array_sort(F.collect_set(F.struct(order.alias("h"), "own"))), 1, 64).alias("pivots"), F.max(wanted).alias("wanted"))
    pivots = durable(pivots.select("cell", F.transform(F.slice("pivots", 1, F.col("wanted")), lambda p: p["own"]).alias("pivots")))
    distances = F.transform("pivots", lambda p: F.levenshtein(F.col("own"), p))
    chosen = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.element_at("d", i + 1) <= F.array_min("d") + 2 * radius)
    nearest = F.array_position("d", F.array_min("d")).cast("int") - 1
    some = big.filter(F.pmod(F.xxhash64("f"), F.lit(16)) == 0).join(pivots, "cell").withColumn("d", distances)
    parting = durable(some.groupBy("cell").agg(F.avg(F.size(chosen)).alias("copies")).filter(F.col("copies") <= _COPIES).join(pivots, "cell").select("cell", "pivots"))
    near = big.join(parting, "cell", "left").withColumn("d", F.when(F.col("pivots").isNotNull(), distances))
    parted = F.col("d").isNotNull()
    shares = F.ceil(F.col("size") / _SHARE).cast("int")
    # Hashes are spread evenly over the 64-bit numbers, in whose order the shares are.
    share = F.least(shares - 1, F.floor((F.col("f") / 2.0**64 + 0.5) * shares)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), shares - 1), lambda k: F.least(k, share) * shares + F.greatest(k, share))
    placed = near.withColumn("to", F.explode(F.when(parted, F.transform(chosen, lambda k: k.cast("int"))).otherwise(pairs)))
    home = F.col("home") & (F.col("to") == F.when(parted, nearest).otherwise(share * shares + F.col("to") % shares))
    replicated = placed.withColumns({"home": home, "cell": F.xxhash64("cell", "to"), "parted": parted}).drop("pivots", "d", "to", "size")
    sizes = replicated.groupBy("cell").agg(F.when(F.max("parted"), F.count(F.lit(1))).otherwise(0).alias("size"))
    return replicated.drop("parted").join(sizes, "cell")


def whole_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows, which come sorted by ``key``, in frames that hold all rows of each of their keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[key].iloc[-1]
        if held and held[0][key].iloc[0] == last:
            held.append(batch)
            continue
        whole = pd.concat([*held, batch], ignore_index=True)
        tail = whole[key] == last
        held = [whole[tail]]
        if not tail.all():
            yield whole[~tail]
    if held:
        yield pd.concat(held, ignore_index=True)


def near_pairs(parsed: DataFrame, radius: int, cell_size: int, reader: NameReader | None = None) -> DataFrame:
    """(block, f_a, f_b, link) of the spellings whose distinctive words lie within the radius, each once: in the cell that
    is home to the first of the two, where the second one has its replica. With a reader, those that it links, and how."""
    placed = cells(parsed, radius, cell_size).select("block", "cell", "home", "f", "name", "own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, "cell"):
            for (block, _), cell in whole.groupby(["block", "cell"]):
                cell = cell.sort_values("f")
                f, home = cell["f"].tolist(), cell["home"].to_numpy(bool)
                if reader:
                    found = _cell_links(reader, list(zip(f, map(reader.parse, cell["name"]), strict=True)), home)
                else:
                    own = cell["own"].tolist()
                    found = ((f[i], f[j], 2) for i, j in combinations(range(len(f)), 2) if home[i] and distance(own[i], own[j]) <= radius)
                while some := list(islice(found, _PAIRS)):
                    yield pd.DataFrame(some, columns=["f_a", "f_b", "link"]).assign(block=block)[["block", "f_a", "f_b", "link"]]

    return placed.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "block bigint, f_a bigint, f_b bigint, link int")


def components(edges: DataFrame) -> DataFrame:
    """(block, f, root): the spellings of ``edges`` (block, f_a, f_b) with the least spelling they are linked to.

    Every round takes the least label among neighbours and then the label of that label, so that a chain of links needs
    about as many rounds as its length has binary digits. Lineage is cut in the shared checkpoint folder; the loop ends
    when no label changes, which it must, since labels only fall.
    """
    both = durable(edges.select("block", F.col("f_a").alias("f"), F.col("f_b").alias("g")).unionByName(edges.select("block", F.col("f_b").alias("f"), F.col("f_a").alias("g"))))
    labels = durable(both.groupBy("block", "f").agg(F.least(F.min("g"), F.col("f")).alias("root")))
    while True:
        of_g = labels.select("block", F.col("f").alias("g"), F.col("root").alias("seen"))
        offered = both.join(of_g, ["block", "g"]).select("block", "f", "seen")
        # The root of a spelling is offered what its neighbours see, too: trees hook onto each other as wholes.
        hooked = offered.join(labels, ["block", "f"]).select("block", F.col("root").alias("f"), "seen")
        least = offered.unionByName(hooked).groupBy("block", "f").agg(F.min("seen").alias("seen"))
        passed = labels.join(least, ["block", "f"], "left").select("block", "f", F.least("root", "seen").alias("next"), F.col("root").alias("was"))
        jump = passed.select("block", F.col("f").alias("next"), F.col("next").alias("further"))
        new = durable(passed.join(jump, ["block", "next"], "left").select("block", "f", F.least("next", "further").alias("root"), "was"))
        changed = new.filter("root <> was").limit(1).count()
        labels = new.select("block", "f", "root")
        if not changed:
            return labels


def _written(name: str) -> tuple:
    """Orders the written forms of a spelling: the most telling one is the largest."""
    words = len(name.split())
    return words > 1, -sum(not (ch.isalnum() or ch == " ") for ch in name), -words, name


def block_pairs(reader: NameReader, f: list[int], names: list[str], rows: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that are different spellings of one registrant, in pieces: smaller ids, larger ids."""
    best: dict[int, str] = {}
    for k, name in zip(f, names, strict=True):
        if k not in best or _written(name) > _written(best[k]):
            best[k] = name
    if len(best) < 2:
        return
    parsed = [(k, n) for k in sorted(best) if (n := reader.read(best[k])) is not None]
    links = list(_cell_links(reader, parsed))
    if not links:
        return
    root = joined(links)
    members: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, row in zip(f, rows, strict=True):
        if k in root:
            members[root[k]][k].append(row)
    for group in members.values():
        spelled = [np.array(of, np.int64) for of in group.values()]
        for i in range(len(spelled) - 1):
            rest = np.concatenate(spelled[i + 1 :])
            for row in spelled[i]:
                yield np.minimum(row, rest), np.maximum(row, rest)


#: Up to so many names are compared one by one; of more, those that cannot be linked are ruled out in tables of so many cells.
_FEW, _TABLE = 12, 1 << 20


def _cell_links(reader: NameReader, parsed: list[tuple[int, Name]], home: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(f_a, f_b, link) of the names of one cell within the radius, which come by f. Without ``home``, spellings with the
    same parts are compared once for all; with it, only pairs come out whose first name is at home."""
    first: dict[tuple, int] = {}
    kinds: tuple[list, list] = [], []
    for at, (k, n) in enumerate(parsed):
        key = (n.organisation, n.own, n.rest)
        if home is not None or key not in first:
            first[key] = k
            kinds[n.organisation].append((k, n, home is None or home[at]))
        elif reader.compare(n, n):
            yield first[key], k, 2
    for ones in kinds:
        for i, j in _candidates(reader, [n for _, n, _ in ones]):
            if ones[i][2] and (link := reader.compare(ones[i][1], ones[j][1])):
                yield ones[i][0], ones[j][0], link


def _candidates(reader: NameReader, names: list[Name]) -> Iterator[tuple[int, int]]:
    """Positions i < j of the names, all of persons or all of organisations, that may be linked. A letter of one word that
    the other lacks is an edit, and persons need given names that fit, which rules most pairs out before their distance is taken."""
    n = len(names)
    if n <= _FEW:
        yield from combinations(range(n), 2)
        return
    letters = np.array([sum({1 << (ord(ch) & 31 if ch.isascii() else 31) for ch in x.own}) for x in names], np.uint32)
    most = np.array([radius_of(len(x.own)) for x in names], np.uint8)
    size = np.array([min(len(x.own), 32_000) for x in names], np.int16)
    words, given = [], None
    if not names[0].organisation:
        at: dict[str, int] = {}
        given = np.array([at.setdefault(x.rest[0] if x.rest else "", len(at)) for x in names], np.int64)
        words = list(at)
    step = max(1, _TABLE // n)
    for start in range(0, n, step):
        rows, rest = slice(start, start + step), slice(start, None)
        limit = np.minimum(most[rows, None], most[None, rest])
        near = np.abs(size[rows, None] - size[None, rest]) <= limit
        near &= np.bitwise_count(letters[rows, None] & ~letters[None, rest]) <= limit
        near &= np.bitwise_count(letters[None, rest] & ~letters[rows, None]) <= limit
        i, j = np.nonzero(np.triu(near, 1))
        i, j = i + start, j + start
        if given is not None and len(i):
            pairs, which = np.unique(given[i] * len(words) + given[j], return_inverse=True)
            fits = np.array([reader.given_fits(words[p // len(words)], words[p % len(words)]) for p in pairs.tolist()])
            i, j = i[fits[which]], j[fits[which]]
        yield from zip(i.tolist(), j.tolist(), strict=True)


def joined(links: Iterable[tuple[int, int, int]]) -> dict[int, int]:
    """Spelling to the least spelling of its registrant, from the links of one block. A group known by initials joins the
    group it fits, where it fits just one."""
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while (over := up.setdefault(k, k)) != k:
            up[k] = k = up[over]
        return k

    weak = []
    for a, b, link in links:
        x, y = top(a), top(b)
        if link == 2:
            up[max(x, y)] = min(x, y)
        else:
            weak.append((a, b) if link == 1 else (b, a))
    fits: dict[int, set[int]] = defaultdict(set)
    for a, b in weak:
        if top(a) != top(b):
            fits[top(a)].add(top(b))
    for g, of in fits.items():
        if len(of) == 1:
            x, y = top(g), top(next(iter(of)))
            up[max(x, y)] = min(x, y)
    return {k: top(k) for k in list(up)}


#: Blocks of up to so many rows are not worth spreading over several tasks.
_SMALL = 1024


def large_blocks(keyed: DataFrame, share: float, local: int) -> list[int]:
    """Blocks of more rows than one task is to hold: more than ``local``, or than a share of all rows where that is less.
    Fewer than 1/share of them, or than one for each ``local`` rows."""
    counts = durable(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(local, _SMALL)))
    limit = min(local, max(share * keyed.count(), _SMALL))
    return [r["block"] for r in counts.filter(F.col("n") > limit).collect()]


def linked_rows(
    table: DataFrame,
    row: str,
    name: str,
    block: list,
    short_forms: list[tuple[str, str]],
    other_fields: list[list[tuple[str, str]]],
    cell_size: int = 64,
    local: int = 65_536,
    share: float = 0.002,
) -> DataFrame:
    """(row_id_a, row_id_b): all pairs of rows, smaller id first, whose names are different spellings of one registrant.

    ``block`` lists the columns in which the rows of a registrant agree; nulls agree with nulls. Rows whose name is a null
    cell, folds to nothing or is a value of one of ``other_fields`` are in no pair. Spellings linked only through
    initials join the one registrant of the block they fit, and none if they fit several. An empty table gives no pair.

    Blocks are brought together by one shuffle and joined where they are; pairs are handed on as they are found and never
    kept. Blocks of more than ``local`` rows, and those above ``share`` of all rows, are not brought together but
    partitioned by pivots; all ways give the same pairs.
    """
    keyed = table.filter(~is_null_cell(F.col(name))).select(
        F.col(row).alias("row_id"), F.col(name).alias("name"), F.xxhash64(*[F.coalesce(b.cast("string"), F.lit("\u0000")) for b in block]).alias("block"), fold(F.col(name)).alias("flat")
    ).filter("flat <> ''").select("row_id", "name", "block", F.xxhash64("flat").alias("f"))
    keyed = durable(keyed)
    reader = NameReader(common_words(keyed), short_forms, other_fields)
    large = large_blocks(keyed, share, local)
    light = keyed.filter(~F.col("block").isin(*large)) if large else keyed

    def pairs_of(whole: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b = whole["block"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        ends = np.append(starts[1:], len(b))
        many = ends - starts > 1
        f, names, rows = whole["f"].to_numpy(), whole["name"].to_numpy(), whole["row_id"].to_numpy()
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            yield from block_pairs(reader, f[s:e].tolist(), names[s:e].tolist(), rows[s:e].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, "block"):
            a, b, n = [], [], 0
            for x, y in pairs_of(whole):
                a.append(x)
                b.append(y)
                n += len(x)
                if n >= _PAIRS:
                    yield pd.DataFrame({"row_id_a": np.concatenate(a), "row_id_b": np.concatenate(b)})
                    a, b, n = [], [], 0
            if n:
                yield pd.DataFrame({"row_id_a": np.concatenate(a), "row_id_b": np.concatenate(b)})

    parts = light.repartition(F.col("block")).sortWithinPartitions("block")
    pairs = parts.mapInPandas(run, "row_id_a bigint, row_id_b bigint")
    return pairs.unionByName(_large_block_pairs(keyed.filter(F.col("block").isin(*large)), reader, cell_size)) if large else pairs


def _large_block_pairs(keyed: DataFrame, reader: NameReader, cell_size: int) -> DataFrame:
    """The same for blocks of any size: distinct spellings, cells by pivots, links, closure, rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [reader.read(n) for n in batch["name"]]
            batch["own"] = [r.own if r else None for r in read]
            yield batch[batch["own"].notna()]

    parsed = spellings(keyed).mapInPandas(parse, "block bigint, f bigint, name string, size bigint, own string")
    links = durable(near_pairs(durable(parsed), RADIUS, cell_size, reader))
    strong = components(links.filter("link = 2"))
    labels = _with_initials(links, strong)
    members = keyed.join(labels, ["block", "f"]).select("row_id", "block", "root", "f")
    a = members.select("block", "root", F.col("row_id").alias("row_id_a"), F.col("f").alias("f_a"))
    b = members.select("block", "root", F.col("row_id").alias("row_id_b"), F.col("f").alias("f_b"))
    return a.join(b, ["block", "root"]).filter("row_id_a < row_id_b and f_a <> f_b").select("row_id_a", "row_id_b")


def _with_initials(links: DataFrame, strong: DataFrame) -> DataFrame:
    """Labels (block, f, root) in which a group known by initials joins the group it fits, where it fits just one."""
    weak = links.filter("link <> 2").select(
        "block", F.when(F.col("link") == 1, F.col("f_a")).otherwise(F.col("f_b")).alias("f"), F.when(F.col("link") == 1, F.col("f_b")).otherwise(F.col("f_a")).alias("g")
    )
    of_f = strong.select("block", "f", F.col("root").alias("root_f"))
    of_g = strong.select("block", F.col("f").alias("g"), F.col("root").alias("root_g"))
    groups = weak.join(of_f, ["block", "f"], "left").join(of_g, ["block", "g"], "left")
    groups = durable(groups.select("block", "f", F.coalesce("root_f", "f").alias("root"), "g", F.coalesce("root_g", "g").alias("fits")).filter("root <> fits"))
    sure = groups.groupBy("block", "root").agg(F.count_distinct("fits").alias("n"), F.min("fits").alias("to")).filter("n = 1").select("block", F.col("root").alias("f_a"), F.col("to").alias("f_b"))
    ends = groups.select("block", "f", "root").unionByName(groups.select("block", F.col("g").alias("f"), F.col("fits").alias("root")))
    labels = strong.unionByName(ends).distinct()
    # A group of initials may join another one that has joined a third: what they join is closed over in turn.
    if not sure.limit(1).count():
        return labels
    tops = components(sure).select("block", F.col("f").alias("root"), F.col("root").alias("to"))
    return labels.join(tops, ["block", "root"], "left").select("block", "f", F.coalesce("to", "root").alias("root"))
