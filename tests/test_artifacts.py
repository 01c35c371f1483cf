import json

from pyspark.sql import functions as F

from foliospark.functions import artifacts as art
from foliospark.plans import artifact_jobs as aj, layout_boxes


def mapped(col, **answer):
    got = col(json.dumps(answer), art.map_answer)
    return None if got is None else got.asDict()


def test_first_json(col):
    assert json.loads(col('noise {"a": "}"} tail }', art.first_json)) == {"a": "}"}
    assert col("```json\n{\"a\": 1}\n```", art.first_json) == '{"a": 1}'
    assert col("[1]", art.first_json) is None
    assert col("{bad", art.first_json) is None


def test_number_line(col):
    line = {"min": 0, "max": 10, "step": 1, "points": [{"label": "A", "value": 3}, {"label": "B", "value": 99}],
            "highlight_segments": [[8, 3], [2, 4]]}
    got = mapped(col, type="number_line", number_line=line)
    assert got["artifact_type"] == "number_line"
    raw = json.loads(got["raw_data"])
    assert [p["value"] for p in raw["points"]] == [3.0] and raw["highlight_segments"] == [[2.0, 4.0]]
    for bad in ({**line, "min": 10}, {**line, "step": 0}, {**line, "points": []}, {**line, "min": True}):
        assert mapped(col, type="number_line", number_line=bad) is None
    assert mapped(col, type="number_line", number_line=json.dumps(line))["artifact_type"] == "number_line"


def test_decimal_grid(col):
    grid = {"rows": 2, "cols": 2, "cells": [{"count": 99, "color": "red"}, {"count": 1, "color": "pink"}, {"count": 3, "color": "Green"}]}
    raw = json.loads(mapped(col, type="decimal_grid", decimal_grid=grid)["raw_data"])
    assert raw["cells"] == [{"count": 3, "color": "green"}]
    assert mapped(col, type="decimal_grid", decimal_grid={**grid, "rows": 50}) is None
    assert mapped(col, type="decimal_grid", decimal_grid={**grid, "cells": [{"count": -1, "color": "red"}]}) is None


def test_limits_are_the_callers(col):
    line = {"min": 0, "max": 100, "step": 1, "points": [{"label": "A" * (1 + n % 30), "value": n} for n in range(90)],
            "highlight_segments": [[n, n + 1] for n in range(50)]}
    answer = json.dumps({"type": "number_line", "number_line": line})
    raw = json.loads(col(answer, art.map_answer)["raw_data"])
    assert len(raw["points"]) == 90 and len(raw["highlight_segments"]) == 50
    some = art.Limits(points=40, segments=20, label_chars=16)
    raw = json.loads(col(answer, lambda c: art.map_answer(c, some))["raw_data"])
    assert len(raw["points"]) == sum(1 + n % 30 <= 16 for n in range(40)) and len(raw["highlight_segments"]) == 20
    grid = json.dumps({"type": "decimal_grid", "decimal_grid": {"rows": 10, "cols": 10, "cells": [{"count": 1, "color": "red"}] * 80}})
    assert len(json.loads(col(grid, art.map_answer)["raw_data"])["cells"]) == 80
    assert len(json.loads(col(grid, lambda c: art.map_answer(c, art.Limits(cells=60)))["raw_data"])["cells"]) == 60


def test_listing_limits(spark):
    from foliospark.operators import filters as flt, topk

    jobs = spark.range(700).select(F.col("id").alias("job_id"), F.lit("QUARANTINE").alias("status"), F.col("id").alias("updated_at"))
    assert flt.quarantine(jobs).count() == 700
    assert [r.job_id for r in flt.quarantine(jobs, cap=2).orderBy("job_id").collect()] == [698, 699]
    page = topk.paginate(jobs, [F.asc("job_id")], 1, 300)
    assert page.count() == 300 and page.first()["limit"] == 300
    assert topk.paginate(jobs, [F.asc("job_id")], 1, 300, max_limit=200).first()["limit"] == 200


def test_mapping_branches(col):
    svg = "<svg viewBox='0 0 1 1'></svg>"
    assert mapped(col, type="geometry", svg=svg)["artifact_type"] == "geometry_vector"
    assert mapped(col, type="diagram", svg=svg, mermaid="graph TD")["artifact_type"] == "flowchart"
    assert mapped(col, type="operation", latex="$$ 1+1 $$")["raw_data"] == "$$1+1$$"
    assert mapped(col, type="plot", plotly_json={"data": []}) is None
    assert mapped(col, type="plot", plotly_json={"data": [1]})["artifact_type"] == "signal_waveform"
    code = mapped(col, type="code", code="x=1", lang="py", semantic="Illustration")
    assert json.loads(code["render_config_json"]) == {"renderer": "shiki", "theme": "github-dark", "lang": "py", "semantic": "illustration"}
    photo = mapped(col, type="photo", caption_ar="صورة", semantic="demonstration")
    assert (photo["artifact_type"], photo["caption"], photo["semantic"]) == (None, "صورة", "demonstration")
    assert mapped(col, type="photo", semantic="other") is None
    large = json.dumps({"type": "geometry", "svg": "<svg>" + "x" * 210000 + "</svg>"})
    kept = col(large, art.map_answer)
    assert len(kept["raw_data"]) == 210011 and len(kept["searchable_text"]) == 210011
    assert col(large, lambda c: art.map_answer(c, art.Limits(svg_bytes=200 * 1024))) is None
    assert len(col(large, lambda c: art.map_answer(c, art.Limits(search_chars=500)))["searchable_text"]) == 500
    assert mapped(col, type=5, caption_ar=7) is None


def test_render_family(spark):
    df = spark.createDataFrame([("KATEX", "x"), (None, "bode_plot"), (None, "unknown"), ("other", "molecule")], "r string, t string")
    got = [r[0] for r in df.select(art.render_family(F.col("r"), F.col("t"))).collect()]
    assert got == ["matrix", "signal_waveform", "other", "smiles_chem"]


def test_area_ratio(spark):
    df = spark.sql("select named_struct('x0', 0D, 'y0', 0D, 'x1', 50D, 'y1', 50D) as b, named_struct('x0', 5D, 'y0', 0D, 'x1', 5D, 'y1', 9D) as z")
    row = df.select(art.area_ratio(F.col("b"), F.lit(100), F.lit(100)), art.area_ratio(F.col("z"), F.lit(100), F.lit(100)),
                    art.strict_area_ratio(F.col("z"), F.lit(100), F.lit(100))).first()
    assert tuple(row) == (0.25, None, 1.0)


def test_artifact_dimension(spark):
    dim = art.artifact_dim(spark)
    assert dim.agg(F.countDistinct("family_no")).first()[0] == 25
    assert dim.where("artifact_type = 'matrix'").first()["renderer"] == "katex"


def page_fits(b, width=2480, height=3508):
    w, h = b[2] - b[0], b[3] - b[1]
    return w > 0 and h > 0 and 0.005 <= w * h / (width * height) <= 0.92 and max(w / h, h / w) <= 25


def overlap(a, b):
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def together(boxes, width, height):
    """Boxes that overlap, grown to their hull until none overlap."""
    boxes = list(boxes)
    while True:
        pair = next(((i, k) for i in range(len(boxes)) for k in range(i) if overlap(boxes[i], boxes[k])), None)
        if pair is None:
            return boxes
        a, b = boxes.pop(pair[0]), boxes.pop(pair[1])
        boxes.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


BOX = "document_id int, page_number int, box_no int, x0 double, y0 double, x1 double, y1 double, is_text boolean, width_px int, height_px int"


def test_merge_overlapping_boxes(spark):
    import random

    rng = random.Random(3)
    rows, pages = [], {}
    for page in range(1, 9):
        for n in range(14):
            x, y = rng.randrange(0, 2000), rng.randrange(0, 3000)
            w, h = rng.randrange(420, 700), rng.randrange(420, 700)
            rows.append((1, page, n, float(x), float(y), float(min(2480, x + w)), float(min(3508, y + h)), n % 3 == 0, 2480, 3508))
            pages.setdefault(page, []).append(rows[-1])
    df = spark.createDataFrame(rows + rows[:20], BOX)
    got = layout_boxes.merge_boxes(df.repartition(3)).collect()
    pad = 14
    for page, boxes in pages.items():
        want = [b for b in together([b[3:7] for b in boxes if page_fits(b[3:7])], 2480, 3508) if page_fits(b)]
        padded = sorted((max(0, b[0] - pad), max(0, b[1] - pad), min(2480, b[2] + pad), min(3508, b[3] + pad)) for b in want)
        own = sorted((g for g in got if g.page_number == page), key=lambda g: g.region_no)
        assert sorted((g.x0, g.y0, g.x1, g.y1) for g in own) == padded
        assert [g.region_no for g in own] == list(range(len(own)))
        assert [(g.y0, g.x0) for g in own] == sorted((g.y0, g.x0) for g in own)


def test_merge_fragments(spark):
    def row(n, x0, y0, x1, y1, text=False):
        return (1, 1, n, float(x0), float(y0), float(x1), float(y1), text, 2480, 3508)

    rows = [row(0, 100, 100, 1100, 1100), row(1, 1120, 300, 1400, 480), row(2, 1500, 300, 1760, 480, True),
            row(3, 100, 1800, 900, 2900, True), row(4, 100, 2000, 110, 2001)]
    got = layout_boxes.merge_boxes(spark.createDataFrame(rows, BOX)).orderBy("region_no").collect()
    assert [(g.x0, g.y0, g.x1, g.y1, g.is_text) for g in got] == [
        (86.0, 86.0, 1414.0, 1114.0, False), (1486.0, 286.0, 1774.0, 494.0, True), (86.0, 1786.0, 914.0, 2914.0, True)]
    first = layout_boxes.merge_boxes(spark.createDataFrame(rows, BOX), max_regions=1).collect()
    assert [g.is_text for g in first] == [False]


def test_explode_elements(spark):
    frames = spark.sql("select 'f' as artifact_id, 'd' as document_id, 1 as page_number, named_struct('x0', 100D, 'y0', 50D, 'x1', 1100D, 'y1', 2050D) as bbox")
    rows = [("f", 0, '{"type": "photo", "caption_ar": "c"}', 10.0, 10.0, 50.0, 50.0), ("f", 1, "{}", 100.0, 100.0, 500.0, 500.0),
            ("f", 2, "{}", 1.0, 1.0, 1.5, 2.0), ("f", 12, "{}", 10.0, 10.0, 50.0, 50.0)]
    el = spark.createDataFrame(rows, "frame_id string, element_no int, answer string, x0 double, y0 double, x1 double, y1 double")
    assert aj.explode_elements(frames, el).count() == 3
    got = aj.explode_elements(frames, el, max_elements=12).collect()
    assert [tuple(g.bbox) for g in got] == [(200.0, 250.0, 600.0, 1050.0)] * 2
    assert {g.artifact_type for g in got} == {"dense_illustration"}


def test_boxes_of_settled_pages_take_no_further_part(spark, monkeypatch):
    """Page 1 needs several rounds, page 2 has nothing to merge, and page 3 has a single box."""
    side = lambda n: (100.0 + 300 * n, 100.0, 450.0 + 300 * n, 500.0)
    rows = [(1, 1, n, *side(n)) for n in range(5)] + [(1, 2, 0, 100.0, 100.0, 500.0, 500.0), (1, 2, 1, 1500.0, 2000.0, 1900.0, 2400.0)]
    rows += [(1, 3, 0, 100.0, 100.0, 500.0, 500.0), (None, 4, 0, 100.0, 100.0, 500.0, 500.0)]
    boxes = spark.createDataFrame(rows, "document_id int, page_number int, box_no int, x0 double, y0 double, x1 double, y1 double").selectExpr(
        "*", "false AS is_text", "2480 AS width_px", "3508 AS height_px")
    rounds, pairs = [], layout_boxes._pairs

    def seen(state):
        rounds.append({r.page_number for r in state.select("page_number").distinct().collect()})
        return pairs(state)

    monkeypatch.setattr(layout_boxes, "_pairs", seen)
    found = {(r.document_id, r.page_number): r.n for r in layout_boxes.merge_boxes(boxes).groupBy("document_id", "page_number").agg(
        F.count("*").alias("n")).collect()}
    assert found == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (None, 4): 1}
    assert len(rounds) > 2 and rounds[0] == {1, 2, 3, 4} and all(r == {1} for r in rounds[1:])
