"""Problem 4: match the entries of two lists of works that share no key.

1. An entry is a record with attributes: the words of its name in Latin and in Hebrew letters, place and year of the
   edition, number of words, category. Words are cut into tokens: runs of two and three letters.
2. Random walks over the graph of records, attributes and tokens: from a record to one of its nodes (a token, a frequent
   word, an attribute's value), from there to a random record that has it too, and on. The nodes that a walk passes and
   those beside its records are its sentence; skip-gram trains vectors of the nodes. Spellings that stand for one another
   (``kh`` and ``ch``), words of one meaning (by the other language's words beside them) come to lie together. Records'
   own nodes are walked through but not written, so the vocabulary is bounded by alphabets and frequent words.
   A record's vector is the sum of the vectors of its rare words' tokens, weighted by their rarity.
3. Blocking: tables of random hyperplanes; records with equal sides in a table are candidates, and every record of the
   first list also looks into the buckets behind its two least certain planes. Crowded buckets are cut by more planes.
   Tables are added as planes are.
4. Rerank: the exact cosine of the pair; then the rare words of both names are aligned one to one by the exact cosines of
   their vectors and their letters, and every frequent word is given its counterpart, the most similar frequent word of
   the other name.
5. Calibration: what a cosine, an alignment, a word's counterpart or its lack is worth is not told but learned, from the
   shares of every outcome among matches and others, by expectation maximisation over all candidates. The posterior is
   the confidence. So that a missing ``Zuta`` parts two works and a missing ``Midrash`` does not is found in the data.

Defined cases: a null attribute is compared as unknown; entries without any name match nothing; equal entries all
match alike, and an old entry goes to its best file (ties: the file that comes first by name); empty tables give no
pairs.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.operators.order import global_index
from annalist.session import discard, materialize

DIM, SEED = 48, 3
#: Records of a bucket beyond which it is cut by more planes.
CAP = 64
#: Words in at least this share of the records (and in FREQUENT_LEAST of them) are frequent: at most 1/share times the
#: words of a name of them, about 2,000.
FREQUENT, FREQUENT_LEAST = 0.004, 8
#: Walks from every record, hops of a walk, nodes written of every record on it.
WALKS, HOPS, BESIDE = 5, 2, 12
#: Candidates of a smaller cosine, or with fewer of their letters equal in both scripts, are no matches.
LEAST_COSINE, LEAST_LETTERS = 0.35, 0.45

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def name_words(name: str | None) -> list[str]:
    """Words of a name in one form: compatibility forms, lower case, no marks; apostrophes and quotes join."""
    if not name:
        return []
    s = unicodedata.normalize("NFKD", _CAMEL.sub(" ", name)).lower()
    return _WORD.findall("".join(c for c in s if not unicodedata.combining(c) and c not in "'\"׳״’"))


def word_tokens(word: str) -> list[str]:
    """Runs of letters of a word: two in Hebrew letters; two and three in others, which write vowels too."""
    s = f"^{word}$"
    if "א" <= word[0] <= "ת":
        return [f"h:{s[i:i + 2]}" for i in range(len(s) - 1)]
    return [f"m:{s[i:i + 2]}" for i in range(len(s) - 1)] + [f"l:{s[i:i + 3]}" for i in range(len(s) - 2)]


def _number(x) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return v if math.isfinite(v) and v > 0 else None


_FIELDS = "latin array<string>, hebrew array<string>, place string, year int, words double, category string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _entries(df: DataFrame, read) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = []
            for r in f.astype(object).where(f.notna(), None).itertuples(index=False):
                name, hebrew, place, year, words, category = read(r)
                rows.append((r.id, name_words(name), name_words(hebrew), place[:3].lower() if place else None, int(_number(year)) if _number(year) else None, _number(words), category))
            yield pd.DataFrame(rows, columns=["id", *_NAMES]).astype({"year": "Int32", "words": "float64"})

    return df.mapInPandas(run, f"id string, {_FIELDS}")


def read_catalog(df: DataFrame) -> DataFrame:
    """Records of corpus_catalog; the filename's last parts stand for a missing title and for the edition."""

    def read(r):
        *parts, last = re.sub(r"_?Sefaria\.jsonl?$", "", r.id).rstrip("-").split("-")
        edition = re.fullmatch(r"([A-Z]+)(\d{4})", last)
        book = parts[-1] if edition and parts else last
        return r.title or book.replace("_", " "), r.he_title, edition and edition[1], edition and edition[2], r.words, r.cat1

    cols = [F.col("filename").alias("id"), "title", "he_title", "words", "cat1"]
    return _entries(df.where("filename IS NOT NULL").select(*cols), read)


def read_old(df: DataFrame) -> DataFrame:
    """Records of old_catalog; the filename's last part stands for a missing name."""

    def read(r):
        last = re.sub(r"-?\.jsonl?$", "", r.old_filename or "").split("-", 2)[-1]
        return r.en_name or last, r.he_name, r.print_place, r.print_year, r.n_words, r.category

    cols = [F.col("old_id").cast("string").alias("id"), "old_filename", "he_name", "en_name", "category", "n_words", "print_place", "print_year"]
    return _entries(df.where("old_id IS NOT NULL").select(*cols), read)


def frequent_words(records: DataFrame) -> dict[str, int]:
    """Frequent words and the number of records that hold them."""
    words = records.select("rid", F.explode(F.array_distinct(F.concat("latin", "hebrew"))).alias("w"))
    least = max(FREQUENT * records.count(), FREQUENT_LEAST)
    return {r.w: r.n for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}


def with_nodes(records: DataFrame, frequent: set[str]) -> DataFrame:
    """records with ``nodes``: tokens of its words, its frequent words, and its attributes' values."""
    schema = T.StructType([*records.schema.fields, T.StructField("nodes", T.ArrayType(T.StringType()))])

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                words = [*r.latin, *r.hebrew]
                nodes = [t for w in words for t in word_tokens(w)] + [f"w:{w}" for w in words if w in frequent]
                nodes += [f"{tag}:{v}" for tag, v in (("y", r.year), ("e", r.place), ("c", r.category)) if not pd.isna(v)]
                nodes += [] if pd.isna(r.words) else [f"n:{math.floor(math.log(r.words) * 6)}"]
                out.append(list(dict.fromkeys(nodes)))
            yield f.assign(nodes=out)

    return records.mapInPandas(run, schema)


def random_walks(records: DataFrame, seed: int = SEED) -> DataFrame:
    """(walk array<string>): WALKS walks from every record, record - node - record - node - record.

    The records of a node are numbered, so a hop is a join on that number: a hot node's walkers spread over its records.
    """
    posts = global_index(records.select("rid", F.explode("nodes").alias("node")), "node", F.xxhash64("rid", F.lit(seed)), out="at")
    posts = materialize(posts.select("node", "at", "rid"), "posts")
    span = posts.groupBy("node").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    dice = lambda k, of: F.pmod(F.xxhash64("walk", F.lit(k), F.lit(seed)), of.cast("long"))
    beside = lambda k: F.slice(F.transform(F.array_sort(F.transform("nodes", lambda x: F.struct(F.xxhash64(x, "walk", F.lit(k)).alias("h"), x.alias("x")))), lambda s: s["x"]), 1, BESIDE)
    r = records.select("rid", "nodes")
    w = r.withColumn("walk", F.explode(F.transform(F.sequence(F.lit(0), F.lit(WALKS - 1)), lambda i: F.xxhash64("rid", i)))).withColumn("text", beside(0))
    for hop in range(1, HOPS + 1):
        w = w.where("size(nodes) > 0").select("walk", "text", F.get("nodes", dice(10 * hop, F.size("nodes")).cast("int")).alias("node"))
        w = w.join(span, "node").select("walk", "text", "node", (F.col("first") + dice(10 * hop + 1, F.col("n"))).alias("at"))
        w = w.join(posts.select("at", "rid"), "at").join(r, "rid").select("walk", "nodes", F.concat("text", F.array("node"), beside(hop)).alias("text"))
    return w.select(F.col("text").alias("walk"))


def train_vectors(records: DataFrame, seed: int = SEED) -> dict[str, np.ndarray]:
    """Skip-gram vectors of all nodes. Their number is bounded by the alphabets (pairs and triples of letters), the years, a
    few closed lists and the frequent words: below 40,000, or 8 MB."""
    from pyspark.ml.feature import Word2Vec

    walks = materialize(random_walks(records, seed), "walks")
    if not walks.take(1):
        return {}
    parts = max(1, min(64, walks.rdd.getNumPartitions()))
    model = Word2Vec(vectorSize=DIM, minCount=1, numPartitions=parts, maxIter=1, stepSize=0.05, seed=seed, windowSize=8, inputCol="walk", outputCol="v", maxSentenceLength=64).fit(walks)
    return {r["word"]: np.array(r["vector"], np.float32) for r in model.getVectors().collect()}


#: Leading directions of the tokens' vectors, which all of them share, that are taken out.
SHARED = 8


def weighted(records: DataFrame, vectors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Unit vectors of the nodes about their mean and without the directions that all tokens share, weighted by rarity."""
    n = records.count()
    df = {r["node"]: r["n"] for r in records.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}  # as bounded as the vectors
    known = [t for t in vectors if t in df]
    if not known:
        return {}
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    x = np.stack([vectors[t] for t in known])
    x = unit(x - x.mean(axis=0))
    token = np.array([t[:2] in ("h:", "m:", "l:") for t in known])
    lead = np.linalg.svd(x[token], full_matrices=False)[2][:SHARED] if token.sum() > DIM else np.zeros((0, DIM))
    rare = np.log(1 + n / np.array([df[t] for t in known]))
    return dict(zip(known, (unit(x - x @ lead.T @ lead) * rare[:, None]).astype(np.float32), strict=True))


def tables_for(bits: int) -> int:
    """Tables of ``bits`` planes: four more for every plane above eight."""
    return 24 + 4 * max(bits - 8, 0)


#: Places kept of each table's least certain planes.
_WEAK = 8


def record_vectors(records: DataFrame, table: dict[str, np.ndarray], frequent: set[str], tables: int) -> DataFrame:
    """records with the rare words of both scripts (all words where none is rare), ``vec`` (unit length; of the tokens of the rare words, or of all words where none is rare), ``codes`` (sides of 32 planes in each table) and ``weak`` (each table's least
    certain planes, from the least certain on)."""
    planes = np.random.default_rng(SEED).standard_normal((DIM, tables * 32)).astype(np.float32)
    place = 1 << np.arange(31, -1, -1, dtype=np.int64)
    more = [T.StructField("rare_latin", T.StringType()), T.StructField("rare_hebrew", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("weak", T.ArrayType(T.ArrayType(T.IntegerType())))]

    def run(frames):
        for f in frames:
            words = [[*a, *b] for a, b in zip(f.latin, f.hebrew, strict=True)]
            name = [[t for w in ([w for w in ws if w not in frequent] or ws) for t in word_tokens(w)] for ws in words]
            x = np.stack([np.sum([table[t] for t in ts if t in table] or [np.zeros(DIM)], axis=0) for ts in name]) if len(f) else np.zeros((0, DIM))
            x = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
            z = (x @ planes).reshape(len(f), tables, 32)
            rare = [[" ".join([w for w in ws if w not in frequent] or ws) or None for ws in f[c]] for c in ("latin", "hebrew")]
            yield f.assign(rare_latin=rare[0], rare_hebrew=rare[1], vec=list(x), codes=list((z > 0) @ place), weak=[[list(map(int, t)) for t in r] for r in np.argsort(np.abs(z), axis=2)[:, :, :_WEAK]])

    return records.mapInPandas(run, T.StructType([*records.schema.fields, *more]))


def candidates(records: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs of a record of side a and one of side b that share a bucket in some table, or would if one or both of
    a's two least certain sides were the other.

    A bucket is the first ``bits`` sides; where it holds more than CAP records it is cut by 6 more, up to all 32.
    Records with equal attributes were merged before, so a full code is shared by few.
    """
    c = records.select("rid", "side", F.posexplode(F.arrays_zip("codes", "weak")).alias("tbl", "z")).select("rid", "side", "tbl", F.col("z.codes").alias("code"), F.col("z.weak").alias("weak"))
    pairs, depth, last = None, bits, None
    while True:
        c = c.withColumn("bucket", F.shiftright("code", 32 - depth))
        size = c.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n"))
        sized = materialize(c.join(size, ["tbl", "bucket"]), "buckets")
        if last is not None:
            discard(last)
        last = sized
        now = sized if depth == 32 else sized.where(F.col("n") <= CAP)
        flips = F.transform(F.slice(F.filter("weak", lambda p: p < depth), 1, 2), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth - 1) - p).cast("int")))
        one, two = F.coalesce(F.get("f", F.lit(0)), F.lit(0).cast("long")), F.coalesce(F.get("f", F.lit(1)), F.lit(0).cast("long"))
        a = sized.where("side = 'a'").withColumn("f", flips).select("tbl", F.col("rid").alias("a"), F.explode(F.array_distinct(F.transform(F.array(F.lit(0).cast("long"), one, two, one.bitwiseXOR(two)), lambda m: F.col("bucket").bitwiseXOR(m)))).alias("bucket"))
        b = now.where("side = 'b'").select("tbl", "bucket", F.col("rid").alias("b"))
        p = materialize(a.join(b, ["tbl", "bucket"]).select("a", "b").distinct(), "candidates")
        pairs = p if pairs is None else pairs.unionByName(p)
        c = sized.where(F.col("n") > CAP).select("rid", "side", "tbl", "code", "weak")
        if depth == 32 or not c.take(1):
            discard(sized)
            return pairs.distinct()
        depth = min(32, depth + 6)


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def edit_distance(a: str, b: str) -> int:
    """Letters to put in, take out or change."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Aligner:
    """Compares names by the vectors of their words; words and pairs of words are remembered."""

    STEPS = (0.2, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.999)

    def __init__(self, table: dict[str, np.ndarray], frequent: set[str]):
        self.table, self.frequent = table, frequent
        self.vector = functools.lru_cache(50_000)(self._vector)
        self.similar = functools.lru_cache(100_000)(self._similar)
        self.split = functools.lru_cache(20_000)(self._split)
        self.counterparts = functools.lru_cache(50_000)(self._counterparts)

    def _vector(self, word: str) -> np.ndarray:
        own = self.table.get(f"w:{word}") if word in self.frequent else None
        parts = [self.table[t] for t in word_tokens(word) if t in self.table] if own is None else [own]
        v = np.sum(parts, axis=0) if parts else np.zeros(DIM)
        return v / (np.linalg.norm(v) + 1e-9)

    def _similar(self, a: str, b: str) -> float:
        """The cosine of two frequent words; with a rare word, the mean of the cosine and the share of equal letters."""
        if a == b:
            return 1.0
        cosine = float(self.vector(a) @ self.vector(b))
        if a in self.frequent and b in self.frequent:
            return cosine
        most = max(len(a), len(b))
        if (cosine + 1 - abs(len(a) - len(b)) / most) / 2 < self.STEPS[0]:  # below the first level whatever the letters are
            return 0.0
        return (cosine + 1 - edit_distance(a, b) / most) / 2

    def _split(self, words: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(rare words, the frequent ones in order)."""
        return tuple(w for w in words if w not in self.frequent), tuple(sorted({w for w in words if w in self.frequent}))

    def _counterparts(self, a: tuple[str, ...], b: tuple[str, ...], tag: str) -> tuple[list[tuple[str, str]], int]:
        """(outcomes, how many lack a counterpart) of the frequent words of two names."""
        out, taken = [], set()
        for w in a:
            s, to = max(((self.similar(w, v), v) for v in b), default=(0.0, ""))
            if s >= 0.2:
                taken.add(to)
            out.append((f"{tag}>{w}", to if s >= 0.2 else ""))
        out += [(f"{tag}<{w}", str(w in taken)) for w in b]
        return out, sum(v in ("", "False") for _, v in out)

    def _rare(self, a: tuple[str, ...], b: tuple[str, ...]) -> list[float]:
        """Similarities of rare words aligned one to one, from the best pair on."""
        if len(a) == len(b) == 1:
            return [self.similar(a[0], b[0])]
        left, right, got = set(range(len(a))), set(range(len(b))), []
        for s, i, j in sorted(((self.similar(w, v), i, j) for i, w in enumerate(a) for j, v in enumerate(b)), key=lambda x: (-x[0], x[1], x[2])):
            if i in left and j in right:
                left.remove(i)
                right.remove(j)
                got.append(s)
        return got

    def outcomes(self, a: list[str], b: list[str], tag: str) -> tuple[list[tuple[str, str]], int]:
        """(outcomes, lacks) of two names in one script, outcomes as (variable, value): how well the best pair of rare words
        and the worst of the others agree when they are aligned one to one, how many are left over, and the counterparts
        of frequent words."""
        if not a or not b:
            return [(tag, "unknown")], 0
        (rare_a, often_a), (rare_b, often_b) = self.split(tuple(a)), self.split(tuple(b))
        out = [(tag, "bare")]
        if rare_a and rare_b:
            got = self._rare(rare_a, rare_b)
            out = [(tag, str(_level(got[0], self.STEPS))), (f"{tag}.next", str(_level(got[-1], self.STEPS)) if len(got) > 1 else "none"), (f"{tag}.over", str(min(abs(len(rare_a) - len(rare_b)), 2)))]
        more, lacks = self.counterparts(often_a, often_b, tag)
        return out + more, lacks


#: Classes of pairs: one work in one edition, one work in other editions or parts, different works.
_CLASSES = 3
#: What is told once counts in full, what both scripts tell (and the cosine of both) counts half.
_TOLD_ONCE = ("year", "place", "category", "words")


def _code(variable: str, value: str) -> int:
    """An outcome as a number, its variable in the upper half."""
    return (zlib.crc32(variable.encode()) >> 1 << 32) | zlib.crc32(value.encode())


def _start(outcomes: list[tuple[str, str]], lacks: int) -> int:
    """First guess of a pair's class: rare words alike in every script known, and no contradiction of the editions."""
    o = dict(outcomes)
    names = [int(o[k]) for k in ("latin", "hebrew", "latin.next", "hebrew.next") if o.get(k, "").isdigit()]
    alike = bool(names) and min(names) >= 3 and sum(names) >= 4.5 * len(names) and o.get("latin.over", "0") == o.get("hebrew.over", "0") == "0"
    against = o["year"] in ("other", "01") or o["place"] in ("other", "01") or o["words"] in ("0", "1") or lacks > 2
    return (1 if against else 0) if alike else 2


def compare(pairs: DataFrame, records: DataFrame, table: dict[str, np.ndarray], frequent: set[str]) -> DataFrame:
    """(b, c): every record of side b with its candidates (a, cosine, start, codes) that reach LEAST_LETTERS and
    LEAST_COSINE. The letters, edit distances in the JVM, come first: they need no vectors. A record has at most four times CAP candidates per table and depth, so the list is bounded."""
    cols = ["rid", "vec", *_NAMES]
    a = records.where("side = 'a'").select(*[F.col(c).alias(f"{c}_a") for c in cols])
    b = records.where("side = 'b'").select(*[F.col(c).alias(f"{c}_b") for c in cols])
    name = records.select("rid", "side", "rare_latin", "rare_hebrew")
    one, two = (name.where(f"side = '{x}'").select(F.col("rid").alias(x), F.col("rare_latin").alias(f"l_{x}"), F.col("rare_hebrew").alias(f"h_{x}")) for x in "ab")
    same = lambda x, y: F.coalesce(1 - F.levenshtein(F.col(x), F.col(y)) / F.greatest(F.length(x), F.length(y)), F.lit(0.0))
    near = pairs.join(one, "a").join(two, "b").where(F.greatest(same("l_a", "l_b"), same("h_a", "h_b")) >= LEAST_LETTERS).select("a", "b")
    j = near.join(a, near.a == a.rid_a).join(b, near.b == b.rid_b).drop("rid_a", "rid_b")

    def edition(x, y, near=lambda p, q: False) -> str:
        if x is None or y is None:
            return f"{x is not None:d}{y is not None:d}"
        return "same" if x == y else "near" if near(x, y) else "other"

    def digits(x, y) -> bool:
        return abs(x - y) <= 2 or sum(p != q for p, q in zip(str(x), str(y), strict=False)) == 1

    def run(batches):
        names = Aligner(table, frequent)
        code = functools.lru_cache(100_000)(_code)
        for t in batches:
            x, y = (t.column(c).flatten().to_numpy().reshape(-1, DIM) for c in ("vec_a", "vec_b"))
            cosine = (x * y).sum(1)
            keep = np.flatnonzero(cosine >= LEAST_COSINE)
            d = {n: t.column(n).take(pa.array(keep)).to_pylist() for n in t.schema.names if not n.startswith("vec")}
            codes, start = [], []
            for i, c in enumerate(cosine[keep]):
                p, q = d["words_a"][i], d["words_b"][i]
                latin, l_lacks = names.outcomes(d["latin_a"][i], d["latin_b"][i], "latin")
                hebrew, h_lacks = names.outcomes(d["hebrew_a"][i], d["hebrew_b"][i], "hebrew")
                o = [("year", edition(d["year_a"][i], d["year_b"][i], digits)), ("place", edition(d["place_a"][i], d["place_b"][i])), ("category", edition(d["category_a"][i], d["category_b"][i]))]
                o += [("words", "unknown" if p is None or q is None else str(_level(-abs(math.log(p / q)), (-1.0, -0.3, -0.06)))), ("cosine", str(_level(c, (0.5, 0.6, 0.7, 0.8, 0.9)))), *latin, *hebrew]
                codes.append([code(*z) for z in o])
                start.append(_start(o, l_lacks + h_lacks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["a"], pa.int64()), pa.array(d["b"], pa.int64()), pa.array(cosine[keep].astype(np.float64)), pa.array(start, pa.int32()), pa.array(codes, pa.list_(pa.int64()))],
                names=["a", "b", "cosine", "start", "codes"],
            )

    c = j.mapInArrow(run, "a long, b long, cosine double, start int, codes array<long>")
    return c.groupBy("b").agg(F.collect_list(F.struct("a", "cosine", "start", "codes")).alias("c"))


def calibrate(compared: DataFrame, rounds: int = 8) -> DataFrame:
    """(a, b, cosine, confidence, weight): the candidates with their confidence and its log odds.

    A latent-class model with outcomes independent within a class, fitted by expectation maximisation over all
    candidates. Since an entry of side b has at most one work of side a in its edition, what its candidates' posteriors of
    the first class have above one together goes to the second; without this the classes drift. A round is one pass that
    adds up the posteriors per outcome; only these sums, one row per outcome, come to the driver. Outcomes are levels,
    frequent words and their counterparts, so there are at most as many as pairs of frequent words that stand for one
    another somewhere.
    """
    known, weights, prior = np.zeros(0, np.int64), np.zeros((0, _CLASSES)), None

    def read(t):
        c = t.column("c")
        sizes, flat = pc.list_value_length(c).to_numpy().astype(np.int64), c.flatten()
        codes, starts = flat.field("codes"), flat.field("start").to_numpy()
        lengths = pc.list_value_length(codes).to_numpy().astype(np.int64)
        return sizes, flat, codes.flatten().to_numpy(), lengths, starts

    def scores(codes, lengths, starts):
        """Log weights of the classes of every candidate."""
        if prior is None:
            s = np.full((len(starts), _CLASSES), math.log(0.01))
            s[np.arange(len(starts)), starts] = math.log(0.98)
            return s
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        w = np.where((known[at] == codes)[:, None], weights[at], 0.0)
        total = np.concatenate([np.zeros((1, _CLASSES)), np.cumsum(w, axis=0)])
        ends = np.cumsum(lengths)
        return prior + total[ends] - total[ends - lengths]

    def sums(batches):
        for t in batches:
            sizes, _, codes, lengths, starts = read(t)
            if not len(starts):
                continue
            s = scores(codes, lengths, starts)
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            record = np.repeat(np.arange(len(sizes)), sizes)
            over = 1 - 1 / np.maximum(np.bincount(record, p[:, 0], len(sizes)), 1)[record]
            p[:, 1] += p[:, 0] * over
            p[:, 0] *= 1 - over
            own, at = np.unique(codes, return_inverse=True)
            pair = np.repeat(np.arange(len(starts)), lengths)
            out = np.stack([np.bincount(at, p[pair, k], len(own)) for k in range(_CLASSES)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, -1]), pa.array(list(np.vstack([out, p.sum(0)])), pa.list_(pa.float64()))], names=["o", "p"])

    once = np.array([zlib.crc32(v.encode()) >> 1 for v in _TOLD_ONCE])
    added = [F.sum(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(_CLASSES)]
    for _ in range(rounds):
        got = compared.mapInArrow(sums, "o long, p array<double>").groupBy("o").agg(*added).toPandas().sort_values("o")
        if not len(got):
            break
        p = got[[f"p{k}" for k in range(_CLASSES)]].to_numpy()
        prior, known, p = np.log(p[0] / p[0].sum()), got["o"].to_numpy()[1:], p[1:]
        _, variable, count = np.unique(known >> 32, return_inverse=True, return_counts=True)
        whole = np.stack([np.bincount(variable, p[:, k]) for k in range(_CLASSES)], 1)[variable]
        # a variable that was seldom seen in a class says little: one observation is spread over its outcomes
        half = np.where(np.isin(known >> 32, once), 1.0, 0.5)[:, None]
        weights = np.log((p + 1 / count[variable][:, None]) / (whole + 1)) * half

    def judge(batches):
        for t in batches:
            sizes, flat, codes, lengths, starts = read(t)
            s = scores(codes, lengths, starts)
            w = s[:, 0] - np.logaddexp(s[:, 1], s[:, 2])
            b = t.column("b").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([flat.field("a"), b, flat.field("cosine"), pa.array(1 / (1 + np.exp(-np.clip(w, -700, 700)))), pa.array(w)], names=["a", "b", "cosine", "confidence", "weight"])

    return compared.mapInArrow(judge, "a long, b long, cosine double, confidence double, weight double")


def prepare(catalog: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(records, members, frequent): records with equal attributes are merged; members (rid, side, id) name the entries."""
    a = read_catalog(catalog).withColumn("side", F.lit("a"))
    b = read_old(old).withColumn("side", F.lit("b"))
    both = a.unionByName(b).where("size(latin) + size(hebrew) > 0").withColumn("rid", F.xxhash64("side", *_NAMES))
    both = materialize(both, "entries")
    records = materialize(both.drop("id").dropDuplicates(["rid"]), "merged")
    frequent = frequent_words(records)
    return materialize(with_nodes(records, set(frequent)), "records"), both.select("rid", "side", "id"), frequent


def blocked(records: DataFrame, frequent: set[str]) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """(records with vectors and codes, vectors of the nodes, planes of a bucket)."""
    table = weighted(records, train_vectors(records))
    bits = min(26, max(4, round(math.log2(max(records.count(), 1))) - 3))
    return materialize(record_vectors(records, table, frequent, tables_for(bits)), "vectors"), table, bits


def match(catalog: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(filename, old_id, confidence): every old entry with its best file, where the confidence reaches ``least``."""
    records, members, frequent = prepare(catalog, old)
    records, table, bits = blocked(records, set(frequent))
    compared = materialize(compare(candidates(records, bits), records, table, set(frequent)), "compared")
    scored = calibrate(compared).where(F.col("confidence") >= least)
    a = members.where("side = 'a'").select(F.col("rid").alias("a"), F.col("id").alias("filename"))
    b = members.where("side = 'b'").select(F.col("rid").alias("b"), F.col("id").cast("long").alias("old_id"))
    pairs = scored.join(a, "a").join(b, "b")
    best = Window.partitionBy("old_id").orderBy(F.desc("confidence"), F.desc("weight"), F.desc("cosine"), "filename")
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("filename", "old_id", "confidence")
