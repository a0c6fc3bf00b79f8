"""Vector functions on ARRAY<FLOAT|DOUBLE> columns; arithmetic is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as tx


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """Scaled to length one; the zero vector stays zero."""
    a = _c(a)
    return tx.bind(
        norm(a),
        lambda size: F.transform(
            a, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / size)
        ),
    )


def cosine(a, b, empty: float = 0.0) -> Column:
    """Cosine similarity; ``empty`` for a zero norm or different lengths."""
    a, b = _c(a), _c(b)
    na, nb = norm(a), norm(b)
    bad = (F.size(a) != F.size(b)) | (na == 0) | (nb == 0)
    return F.when(bad, F.lit(empty)).otherwise(dot(a, b) / (na * nb))


def embedding_bucket(col) -> Column:
    """Coarse key of a vector: eight sampled dimensions, quantised to quarters."""
    v = _c(col)
    step = F.greatest(F.floor(F.size(v) / 8), F.lit(1)).cast("int")
    sampled = F.slice(
        F.filter(
            F.transform(v, lambda x, i: F.when(i % step == 0, x.cast("double"))),
            lambda x: x.isNotNull(),
        ),
        1,
        8,
    )
    cells = F.transform(sampled, lambda x: F.format_string("%.2f", F.rint(x * 4) / 4 + F.lit(0.0)))
    return F.substring(F.sha2(F.array_join(cells, ","), 256), 1, 16)


def mean_vector(col, dim: int) -> Column:
    """Aggregate: component-wise mean of the vectors in a group."""
    return F.array(*[F.avg(F.get(_c(col), i).cast("double")) for i in range(dim)])


def hash_embed(col, dim: int = 32) -> Column:
    """Default embedder: token counts hashed into ``dim`` cells, unscaled.
    Needs no model, so every dense operator runs offline."""

    def cell(token: Column) -> Column:
        return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % dim

    def counts(cells: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda d: (F.size(cells) - F.size(F.array_remove(cells, d))).cast("double"),
        )

    return tx.bind(F.transform(tx.tokenize(F.lower(_c(col))), cell), counts)
