"""String similarity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as a fold over rows of the dynamic programme; runs in the JVM."""
    xs, ys = F.split(a, ""), F.split(b, "")

    def row(prev: Column, x: Column) -> Column:
        cells = F.arrays_zip(ys.alias("y"), F.slice(prev, 1, F.size(ys)).alias("diag"), F.slice(prev, 2, F.size(ys)).alias("up"))
        out = F.aggregate(cells, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.when(c["y"] == x, c["diag"] + 1).otherwise(F.greatest(c["up"], F.element_at(acc, -1))))))
        return out

    zeros = F.array_repeat(F.lit(0), F.size(ys) + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(xs, zeros, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 by insertions and deletions; 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


def damerau_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: swaps of neighbours count once, even with edits between them. The definition; columns
    are compared by near_distance."""
    last: dict[str, int] = {}
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


#: Further apart than near_distance tells.
FAR = 9


def near_distance(a: Column, b: Column) -> Column:
    """damerau_distance where it is 2 or less; something larger otherwise. A fold over the letters of a, in the JVM, of the last three
    rows of the dynamic programme, each of the five cells about the diagonal: at most 2 edits lead nowhere else, and a swap within
    2 edits has one more letter in between at most."""
    n, m = F.length(a), F.length(b)
    none = F.lit(None).cast("string")

    def shifted(x: Column, by: int) -> Column:
        """The letters of x, `by` places further on, as many as a has."""
        return F.slice(F.concat(F.array(*[none] * by), F.split(x, "")) if by > 0 else F.split(x, ""), max(1, 1 - by), n)

    # An element for each letter of a, with the letters that its row looks at; cut once, as a fold would do it at each step.
    letters = F.arrays_zip(F.sequence(F.lit(1), n).alias("i"), *[shifted(a, k).alias(f"x{k}") for k in range(3)], *[shifted(b, 2 - o).alias(f"y{o + 2}") for o in range(-2, 5)])
    # Rows i - 1, i - 2 and i - 3; cell t is at column i - 2 + t.
    beyond = F.array(*[F.lit(FAR)] * 5)
    first = F.array(F.lit(FAR), F.lit(FAR), *[F.when(m >= j, F.lit(j)).otherwise(FAR) for j in range(3)])
    state = F.struct(first.alias("p1"), beyond.alias("p2"), beyond.alias("p3"))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))

    def row(acc: Column, c: Column) -> Column:
        p1, p2, p3 = (lambda t, r=r: F.get(acc[r], F.lit(t)) if 0 <= t < 5 else F.lit(FAR) for r in ("p1", "p2", "p3"))
        x = lambda k: c[f"x{k}"]  # noqa: E731  the letter k before the row's
        y = lambda t, k: c[f"y{t - k + 2}"]  # noqa: E731  the letter k before the cell's
        cells: list[Column] = []
        for t in range(5):
            j = c["i"] - 2 + t
            swap = lambda far, near, of, cost: F.when(far & near, of + cost).otherwise(FAR)
            ways = [
                p1(t) + F.when(same(x(0), y(t, 0)), 0).otherwise(1), p1(t + 1) + 1, swap(same(x(1), y(t, 0)), same(x(0), y(t, 1)), p2(t), 1),
                swap(same(x(2), y(t, 0)), same(x(0), y(t, 1)), p3(t + 1), 2), swap(same(x(1), y(t, 0)), same(x(0), y(t, 2)), p2(t - 1), 2),
            ]
            if cells:
                ways.append(cells[-1] + 1)
            cells.append(F.when(j == 0, c["i"]).when(y(t, 0).isNull(), FAR).otherwise(F.least(*ways)))
        return F.struct(F.array(*[v.cast("int") for v in cells]).alias("p1"), acc["p1"].alias("p2"), acc["p2"].alias("p3"))

    found = F.when(n == 0, m).otherwise(F.get(F.aggregate(letters, state, row)["p1"], m - n + 2))
    return F.when(F.abs(n - m) > 2, FAR).otherwise(F.least(F.coalesce(found, F.lit(FAR)), F.lit(FAR)))


#: Letters of a text whose places are kept as bits of one long, with room for a sum.
MOST_BITS = 60


def letter_places(text: Column) -> Column:
    """For each letter of a text of up to MOST_BITS letters the places it stands at, as bits."""
    xs = F.split(text, "")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    places = lambda c: F.aggregate(F.transform(xs, lambda x, k: F.when(x == c, bit(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.map_from_entries(F.transform(F.array_distinct(xs), lambda c: F.struct(c.alias("k"), places(c).alias("v"))))


def lcs_by_bits(a: Column, b: Column, places: Column) -> Column:
    """lcs_length of a and b, a step of 64-bit arithmetic for each letter of a; places: letter_places(b)."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(b)) - 1

    def step(v: Column, x: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.try_element_at(places, x), F.lit(0).cast("long")))
        return (v + u).bitwiseOR(v - u).bitwiseAND(whole)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.length(b) - F.bit_count(F.aggregate(F.split(a, ""), whole, step)))
