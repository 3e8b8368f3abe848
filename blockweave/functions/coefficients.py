"""The identities of Strassen's product as small signed tables.

Quadrants are (row, column) pairs of 0/1; ``m`` is the 1-based sub-product. Each table has twelve rows per operand, so
joining or looping over it never depends on the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Strassen's seven products.
#   M1 = (A11 + A22)(B11 + B22)    M2 = (A21 + A22) B11    M3 = A11 (B12 - B22)    M4 = A22 (B21 - B11)
#   M5 = (A11 + A12) B22           M6 = (A21 - A11)(B11 + B12)                     M7 = (A12 - A22)(B21 + B22)
#   C11 = M1 + M4 - M5 + M7        C12 = M3 + M5           C21 = M2 + M4           C22 = M1 - M2 + M3 + M6
# One entry is (m, quadrant row, quadrant column, sign).
A_TERMS = (
    (1, 0, 0, 1), (1, 1, 1, 1),
    (2, 1, 0, 1), (2, 1, 1, 1),
    (3, 0, 0, 1),
    (4, 1, 1, 1),
    (5, 0, 0, 1), (5, 0, 1, 1),
    (6, 1, 0, 1), (6, 0, 0, -1),
    (7, 0, 1, 1), (7, 1, 1, -1),
)
B_TERMS = (
    (1, 0, 0, 1), (1, 1, 1, 1),
    (2, 0, 0, 1),
    (3, 0, 1, 1), (3, 1, 1, -1),
    (4, 1, 0, 1), (4, 0, 0, -1),
    (5, 1, 1, 1),
    (6, 0, 0, 1), (6, 0, 1, 1),
    (7, 1, 0, 1), (7, 1, 1, 1),
)
C_TERMS = (
    (1, 0, 0, 1), (4, 0, 0, 1), (5, 0, 0, -1), (7, 0, 0, 1),
    (3, 0, 1, 1), (5, 0, 1, 1),
    (2, 1, 0, 1), (4, 1, 0, 1),
    (1, 1, 1, 1), (2, 1, 1, -1), (3, 1, 1, 1), (6, 1, 1, 1),
)

Term = tuple[int, int, float]


def nested_terms(terms, levels: int) -> dict[int, list[Term]]:
    """Apply a one-level table ``levels`` times.

    Returns sub-problem path (base-7 digits, outermost level first) -> [(quadrant row, quadrant column, sign)], where
    the quadrant coordinates have ``levels`` binary digits each, outermost first.
    """
    flat = [(0, 0, 0, 1.0)]
    for _ in range(levels):
        flat = [
            (path * 7 + m - 1, qr * 2 + r, qc * 2 + c, sign * s)
            for path, qr, qc, sign in flat
            for m, r, c, s in terms
        ]
    table: dict[int, list[Term]] = {}
    for path, qr, qc, sign in flat:
        table.setdefault(path, []).append((qr, qc, sign))
    return table


def _values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def operand_table(spark: SparkSession) -> DataFrame:
    """24 rows ``mat, m, qr, qc, s``: which quadrants, with which sign, form each operand of each sub-product."""
    rows = [
        f"('{mat}', {m}, {r}L, {c}L, {s}D)"
        for mat, terms in (("A", A_TERMS), ("B", B_TERMS))
        for m, r, c, s in terms
    ]
    return _values(spark, rows, "mat, m, qr, qc, s")


def output_table(spark: SparkSession) -> DataFrame:
    """12 rows ``m, qr, qc, s``: which sub-products, with which sign, form each quadrant of the result."""
    return _values(spark, [f"({m}, {r}L, {c}L, {s}D)" for m, r, c, s in C_TERMS], "m, qr, qc, s")
