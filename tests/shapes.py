"""Small geometry helpers for golden cases."""


def ring(points):
    return [(float(x), float(y)) for x, y in points]


def box(x0, y0, x1, y1):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def edges(spark, key, shapes):
    """Edge frame of polygons given as {id: [points, ...]}; each list is one counter-clockwise ring."""
    rows = []
    for name, rings in shapes.items():
        for pts in rings:
            rows += [(name, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]
    kind = "string" if isinstance(next(iter(shapes)), str) else "bigint"
    return spark.createDataFrame(rows, f"{key} {kind}, ax double, ay double, bx double, by double")


def cells(spark, boxes):
    return spark.createDataFrame(
        [(i, *map(float, b)) for i, b in boxes.items()], "id bigint, x0 double, y0 double, x1 double, y1 double"
    )


def people(spark, population):
    return spark.createDataFrame([(k, float(v)) for k, v in population.items()], "source_id bigint, population double")


def rings_column(*rings):
    return [(0, i, pts) for i, pts in enumerate(rings)]
