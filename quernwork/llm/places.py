"""Mapping free-entered values to a canonical list.

`EntryTree` is a BK-tree over the entries of a reference list under the unrestricted Damerau-Levenshtein
distance, which is a true metric (insertions, deletions, substitutions and exchanges of neighbours cost 1),
so the triangle inequality prunes without losing an entry. `match_within` uses it for any list, broadcast
where the list is small and in shards elsewhere; `resolve_places` adds the grammar of place entries.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.functions.text import fold, fold_py
from quernwork.session import bounded_rows, stored, table

#: Lists of up to so many entries become one broadcast tree; longer ones are split into shards of this size. So many distinct values meet a shard in one task.
TREE_ENTRIES, TASK_VALUES = 20_000, 200_000


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n or m
    far, last = n + m, {}
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        at = 0
        for j in range(1, m + 1):
            k, p = last.get(b[j - 1], 0), at
            same = a[i - 1] == b[j - 1]
            if same:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][p] + (i - k - 1) + 1 + (j - p - 1))
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


class EntryTree:
    """A BK-tree of (key, values); entries of equal key share a node."""

    def __init__(self, entries: list[tuple[str, object]]) -> None:
        self.values: dict[str, list] = defaultdict(list)
        for key, value in entries:
            self.values[key].append(value)
        self.root: tuple[str, dict] | None = None
        for key in self.values:
            self._add(key)

    def _add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while True:
            d = edit_distance(key, node[0])
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        """Every (distance, entry key) within the radius."""
        if key in self.values and radius == 0:
            return [(0, key)]
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = edit_distance(key, at)
            if d <= radius:
                found.append((d, at))
            todo += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return sorted(found)


def match_within(values: DataFrame, value_col: str, refs: DataFrame, ref_id: str, ref_name: str, radius: int = 1) -> DataFrame:
    """(value, ref_id, distance): for every distinct value all entries within the radius, after folding; values without an entry get one row of nulls.

    The distinct values are matched once. A list of up to TREE_ENTRIES entries is one tree in every
    task; a longer one is split into shards, each distinct value visits every shard, TASK_VALUES of them in a task, and the shards'
    winners are united. Null and blank values and entries match nothing; equal entries all come out.
    """
    clean = refs.select(ref_id, ref_name).filter(F.col(ref_name).isNotNull()).dropDuplicates()
    vals = values.select(F.col(value_col).alias("value")).distinct()
    kind = dict(refs.dtypes)[ref_id]
    schema = f"value string, `{ref_id}` {kind}, distance int"
    few = clean.limit(TREE_ENTRIES + 1).count() <= TREE_ENTRIES

    def search(tree: EntryTree, texts: pd.Series) -> pd.DataFrame:
        rows = [(t, i, d) for t in texts if (k := squeeze(t)) for d, e in tree.within(k, radius) for i in tree.values[e]]
        return pd.DataFrame(rows, columns=["value", ref_id, "distance"])

    if few:
        entries = [(k, r[ref_id]) for r in bounded_rows(clean, TREE_ENTRIES, "the reference list") if (k := squeeze(r[ref_name]))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = EntryTree(entries)
            for b in batches:
                yield search(tree, b["value"])

        hits = vals.filter("value is not null").mapInPandas(run, schema)
    else:
        shards, salts = -(-clean.count() // TREE_ENTRIES), max(1, -(-vals.count() // TASK_VALUES))
        sharded = clean.withColumn("_shard", F.pmod(F.xxhash64(ref_id, ref_name), F.lit(shards))).withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
        visits = vals.filter("value is not null").withColumn("_shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))).withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(salts)))

        def shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return search(EntryTree([(k, i) for i, n in zip(right[ref_id], right[ref_name], strict=True) if (k := squeeze(n))]), left["value"])

        hits = visits.groupBy("_shard", "_salt").cogroup(sharded.groupBy("_shard", "_salt")).applyInPandas(shard, schema)
    return vals.join(hits, "value", "left")


@lru_cache(100_000)
def squeeze(s: str | None) -> str:
    """Folded letters and digits only."""
    return re.sub(r"[^a-z0-9]+", "", fold_py(s))


#: Countries and regions that make an entry a foreign one.
FOREIGN = re.compile(
    r"\b(?:usa|u\.?s\.?a?\.?|united states(?: of america)?|united kingdom|u\.?k\.?|england|scotland|wales|ireland|northern ireland|great britain|netherlands|france|germany|belgium|australia|new zealand|mexico|india|spain|italy|poland|portugal|etats unis|royaume uni|pays bas)(?![a-z])"
)
#: Provinces by code and name; the list of places may lack some of them.
PROVINCES = {c.lower(): c for c in "AB BC MB NB NL NS NT NU ON PE QC SK YT".split()} | {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL", "nova scotia": "NS", "northwest territories": "NT", "nunavut": "NU", "ontario": "ON", "prince edward island": "PE", "quebec": "QC", "saskatchewan": "SK", "yukon": "YT",
}
_STREETS = r"road|rd|street|str|avenue|ave|boulevard|blvd|boul|drive|dr|lane|ln|crescent|cres|court|highway|hwy|way|route|trail|parkway|pkwy|terrace|concession|line|sideroad"
_STREET = re.compile(rf"^\s*(?:(?:unit|suite|bureau)\s*\S+,?\s*)?\d+[a-z]?(?:-\d+)?,?\s+(?:(?:rue|boul(?:evard)?|av(?:enue)?|chemin|ch|rang|route|montee|place)\b\.?\s[^,]*(?:,|$)|[^,]*?\b(?:{_STREETS})\b\.?(?:\s+(?:n|s|e|w|north|south|east|west|ne|nw|se|sw)\b)?)")
_STREET_MID = re.compile(rf"(?:^|(?<=,))\s*\d+[a-z]?\s+[^,]*?\b(?:{_STREETS})\b\.?")
_POSTAL = re.compile(r"\b[abceghj-nprstvxy]\d[a-z]\s?\d[a-z]\d\b")
_PARTS = re.compile(r"[;|\n/+&]|\s+(?:or|ou|and|et)\s+|\s•\s")
_NOISE = frozenset(
    "canada ca can downtown greater area areas near region de du of the and hybrid on site onsite plant night day shift remote region metro centre ville center central north south east west office head home based field nr grand environs pres banlieue metropolitan gta suburb usine site".split()
)


def _mojibake(s: str) -> str:
    """UTF-8 read as a one-byte code is turned back."""
    if "Ã" in s or "Â" in s:
        for code in ("cp1252", "latin-1"):
            try:
                return s.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        # code points of both one-byte tables mixed
        raw = b"".join(ch.encode("latin-1") if ord(ch) < 256 else ch.encode("cp1252", "replace") for ch in s)
        fixed = raw.decode("utf-8", "replace")
        return s if "�" in fixed else fixed
    return s


class PlaceResolver:
    """Places by the way they are written. rows: (place_id, name, province code, province, alternative name or null); provinces: codes by folded name, of places that aren't among the rows."""

    def __init__(self, rows: list[tuple], provinces: dict[str, str] | None = None) -> None:
        self.by_key: dict[str, set[int]] = defaultdict(set)
        self.province: dict[int, str] = {}
        self.codes: dict[str, str] = PROVINCES | (provinces or {})
        for pid, name, code, province, alt in rows:
            if code:
                self.codes[fold_py(code)] = code
                self.province[pid] = code
                if province:
                    self.codes[fold_py(province)] = code
            for n in (name, alt):
                if n and (k := squeeze(n)):
                    self.by_key[k].add(pid)
        self.longest = max((len(re.findall(r"[a-z0-9]+", fold_py(n))) for r in rows for n in (r[1], r[4]) if n), default=1)
        self.tree = EntryTree([(k, None) for k in self.by_key])
        names = sorted(self.codes, key=len, reverse=True)
        self.code_re = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, names))})(?![a-z0-9])") if names else None
        self.near = lru_cache(50_000)(self._near)

    def _near(self, key: str) -> tuple[str, ...]:
        """Keys at distance 1; a lost, doubled or exchanged letter speaks before a replaced one."""
        if len(key) < 5:
            return ()
        found = [k for d, k in self.tree.within(key, 1) if d == 1]
        unlike = [k for k in found if len(k) == len(key) and sorted(k) != sorted(key)]
        return tuple(k for k in found if k not in unlike) or tuple(unlike)

    def _codes(self, text: str) -> list[tuple[int, str]]:
        return [(m.start(), self.codes[m[0]]) for m in self.code_re.finditer(text)] if self.code_re else []

    def _part(self, part: str) -> list[tuple[frozenset[int], str | None]]:
        """(candidate ids, stated province) for each place that one component of an entry names."""
        t = _STREET_MID.sub(" ", _STREET.sub(" ", part, count=1))
        t = _POSTAL.sub(" ", t)
        words = [(m[0], m.start()) for m in re.finditer(r"[a-z0-9]+", t)]
        codes, found, i = self._codes(t), [], 0
        while i < len(words):
            for n in range(min(self.longest + 1, len(words) - i), 0, -1):
                if ids := self.by_key.get("".join(w for w, _ in words[i : i + n])):
                    found.append((frozenset(ids), i, n))
                    i += n
                    break
            else:
                i += 1
        if not found:
            skip = {i for i, (w, p) in enumerate(words) if w in _NOISE or w.isdigit() or any(a <= p < a + self._length(t, a) for a, _ in codes)}
            i = 0
            while i < len(words):
                if i in skip:
                    i += 1
                    continue
                j = i
                while j < len(words) and j not in skip:
                    j += 1
                best = None
                for n in range(j - i, 0, -1):
                    for k in range(i, j - n + 1):
                        keys = self.near("".join(w for w, _ in words[k : k + n]))
                        if keys:
                            best = (frozenset().union(*(self.by_key[x] for x in keys)), k, n)
                            break
                    if best:
                        break
                if best:
                    found.append(best)
                i = j
        out = []
        for ids, i, n in found:
            ends = words[i + n - 1][1] + len(words[i + n - 1][0])
            after = [c for p, c in codes if p >= ends]
            before = [c for p, c in codes if p < words[i][1]]
            out.append((ids, after[0] if after else before[-1] if before else None))
        return out

    def _length(self, t: str, at: int) -> int:
        return len(self.code_re.match(t, at)[0])

    @staticmethod
    def parts(text: str | None) -> list[str]:
        """The folded components of an entry that aren't foreign."""
        if not text:
            return []
        t = re.sub(r"\bon[- ]?site\b", " ", re.sub(r"\s+", " ", fold_py(_mojibake(text)).replace("œ", "oe"))).strip()
        return [part for part in _PARTS.split(t) if not FOREIGN.search(part)]

    def named(self, text: str | None) -> list[tuple[frozenset[int], str | None]]:
        return [x for part in self.parts(text) for x in self._part(part)]

    def resolve(self, location: str | None, city: str | None) -> list[int]:
        """Ids of the places that the entry names, ascending; [] for none. A place that neither location nor city decides comes out with all its candidates."""
        entry = location if location and location.strip() else city
        out: set[int] = set()
        for ids, code in self.named(entry):
            if code:
                ids = frozenset(i for i in ids if self.province.get(i) == code)
            if len(ids) > 1 and city:
                hints = {i for more, c in self.named(city) for i in more if c and self.province.get(i) == c}
                codes = {c for _, c in self._codes(fold_py(city))}
                ids = frozenset(ids & hints) or frozenset(i for i in ids if self.province.get(i) in codes) or ids
            out |= ids
        return sorted(out)


def place_rows(places: DataFrame) -> list[tuple]:
    return [tuple(r) for r in bounded_rows(places.select("place_id", "place_name", "province_code", "province", "alt_name"), TREE_ENTRIES, "places")]


def resolve_places(df: DataFrame, keys: list[str], location: str, city: str, places: DataFrame) -> DataFrame:
    """(keys..., place_ids array<int>): the places that each row's entry names.

    The entry is location, or city where location is blank; blank entries and entries without a place give an empty
    array. A place in a foreign country, a street's name and a name in a province where the list doesn't have it
    name no place. A list of up to TREE_ENTRIES travels to the tasks, without a shuffle, and equal entries of a task are resolved once; with a
    longer one each distinct entry meets the list's shards and is then resolved among the places that it could name.
    """
    if places.limit(TREE_ENTRIES + 1).count() > TREE_ENTRIES:
        return _resolve_sharded(df, keys, location, city, places)
    rows = place_rows(places)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", place_ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resolver = PlaceResolver(rows)
        known = lru_cache(200_000)(resolver.resolve)
        for b in batches:
            yield b[keys].assign(place_ids=[known(x, y) for x, y in zip(b["_location"], b["_city"], strict=True)])

    return df.select(*keys, F.col(location).alias("_location"), F.col(city).alias("_city")).mapInPandas(run, schema)


def _resolve_sharded(df: DataFrame, keys: list[str], location: str, city: str, places: DataFrame) -> DataFrame:
    """resolve_places() for lists of any size: every run of words of an entry is matched against all shards within one edit, which is all that the resolver could take it for."""
    names = places.select("place_id", F.explode(F.array("place_name", "alt_name")).alias("name")).filter("length(trim(name)) > 0")
    longest = names.agg(F.max(F.size(F.split(F.trim(F.regexp_replace(fold("name"), "[^a-z0-9]+", " ")), " "))).alias("n")).first().n or 1
    said = places.filter("province_code is not null and province is not null").select("province_code", "province").distinct()
    provinces = {fold_py(x): r.province_code for r in bounded_rows(said, TREE_ENTRIES, "the provinces") for x in (r.province, r.province_code)}
    entries = df.select(F.col(location).alias("_location"), F.col(city).alias("_city")).distinct()

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y in zip(b["_location"], b["_city"], strict=True):
                found = {x or "": None, y or "": None}
                words = [re.findall(r"[a-z0-9]+", p) for e in found for p in PlaceResolver.parts(e)]
                rows += [(x, y, k) for k in {"".join(w[i : i + n]) for w in words for n in range(1, longest + 2) for i in range(len(w) - n + 1)}]
            yield pd.DataFrame(rows, columns=["_location", "_city", "value"])

    asked = stored(entries.mapInPandas(runs, "_location string, _city string, value string"), "entry-runs")
    hits = match_within(asked, "value", names, "place_id", "name", 1).filter("place_id is not null").select("value", "place_id").distinct()
    rows = places.select("place_id", F.struct("place_id", "place_name", "province_code", "province", "alt_name").alias("row"))
    could = asked.join(hits, "value").select("_location", "_city", "place_id").distinct().join(rows, "place_id").groupBy("_location", "_city").agg(F.collect_list("row").alias("rows"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ("place_id", "place_name", "province_code", "province", "alt_name")
        for b in batches:
            ids = [PlaceResolver([tuple(r[f] for f in fields) for r in rows], provinces).resolve(x, y) for x, y, rows in zip(b["_location"], b["_city"], b["rows"], strict=True)]
            yield b[["_location", "_city"]].assign(place_ids=ids)

    found = could.mapInPandas(resolve, "_location string, _city string, place_ids array<int>")
    same = df[location].eqNullSafe(found["_location"]) & df[city].eqNullSafe(found["_city"])
    return df.join(found, same, "left").select(*[df[c] for c in keys], F.coalesce("place_ids", F.array().cast("array<int>")).alias("place_ids"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that each job's entry names; 0 for an entry that names none."""
    places = table(spark, sf_dir, "places")
    labels = places.select(F.col("label").alias("location")).filter("location is not null").distinct()
    jobs = table(spark, sf_dir, "jobs").select("job_id", "location", "city")
    stated = jobs.filter(r"regexp_replace(coalesce(location, ''), '[\\s ]+', '') <> '' or regexp_replace(coalesce(city, ''), '[\\s ]+', '') <> ''")
    cases = stated.join(F.broadcast(labels), "location", "left_anti")
    found = resolve_places(cases, ["job_id"], "location", "city", places)
    named = found.select("job_id", F.explode(F.when(F.size("place_ids") > 0, F.col("place_ids")).otherwise(F.array(F.lit(0)))).alias("place_id"))
    return named.select("job_id", F.col("place_id").cast("bigint").alias("place_id"))


def p4_unmatched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every free-typed entry that names no place of the list, and the number of its jobs."""
    jobs = table(spark, sf_dir, "jobs").select("job_id", F.expr(r"if(regexp_replace(coalesce(location, ''), '[\\s ]+', '') <> '', location, city)").alias("entry"))
    none = p4_found(spark, sf_dir).filter("place_id = 0").select("job_id")
    return jobs.join(none, "job_id").groupBy("entry").agg(F.count("*").alias("jobs"))


def p4_nearest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every free-typed city with all entries of the list (by name or alternative name) within one edit; a null place for values without one."""
    places = table(spark, sf_dir, "places")
    names = places.select("place_id", F.explode(F.array("place_name", "alt_name")).alias("name")).filter("name is not null")
    typed = table(spark, sf_dir, "jobs").select("city").filter("length(trim(city)) > 0")
    return match_within(typed, "city", names, "place_id", "name").groupBy("value", "place_id").agg(F.min("distance").alias("distance"))


QUERIES = {"p4_found": p4_found, "p4_unmatched_values": p4_unmatched_values, "p4_nearest_entries": p4_nearest_entries}
