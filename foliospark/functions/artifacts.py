"""Artifact columns: model answers, validators, type mapping, render families."""

from __future__ import annotations

import json
from dataclasses import dataclass
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from foliospark.functions.latex import sanitize_latex
from foliospark.functions.text import strip
from foliospark.schema import SEMANTICS

# Side of a grid, its colours, near-full-page share.
MAX_GRID = 20
GRID_COLORS = ("blue", "red", "green", "orange", "purple", "gray")
AREA_RATIO_MAX = 0.70
TEXT_IMPORT_TYPES = ("geojson_map", "fasta_sequence", "genbank_record", "smiles_chem")

# Render settings per family of artifact types.
RENDER = {
    "katex": {"renderer": "katex", "displayMode": True, "throwOnError": False},
    "svg": {"renderer": "svg", "sanitize": True, "zoomable": True},
    "3dmol": {"renderer": "3dmol", "style": "cartoon", "backgroundColor": "white"},
    "ketcher": {"renderer": "ketcher", "readOnly": True},
    "biojs": {"renderer": "biojs", "format": "fasta"},
    "shiki": {"renderer": "shiki", "lang": "python", "theme": "github-dark"},
    "mermaid": {"renderer": "mermaid", "theme": "default"},
    "three": {"renderer": "three", "format": "gltf"},
    "maplibre": {"renderer": "maplibre", "style": "https://demotiles.maplibre.org/style.json", "zoom": 5},
    "tanstack-table": {"renderer": "tanstack-table", "pagination": True, "pageSize": 20},
    "plotly": {"renderer": "plotly", "type": "scatter"},
    "openseadragon": {"renderer": "openseadragon", "tileSources": None, "showNavigator": True},
    "vexflow": {"renderer": "vexflow", "format": "musicxml"},
    "abcjs": {"renderer": "abcjs", "format": "abc"},
    "img-loupe": {"renderer": "img-loupe", "magnification": 3},
    "web-ifc": {"renderer": "web-ifc", "readOnly": True},
    "param-number-line": {"renderer": "param-number-line", "interactive": False},
    "param-decimal-grid": {"renderer": "param-decimal-grid", "interactive": False},
}
# Fixed values: (family number, tier, {artifact type: renderer}).
FAMILIES = (
    (1, 1, {"latex_formula": "katex", "matrix": "katex", "tensor": "katex"}),
    (2, 2, {"geometry_vector": "svg", "geogebra_xml": "svg"}),
    (3, 1, {"data_table": "tanstack-table", "hierarchical_grid": "tanstack-table"}),
    (4, 2, {"smiles_chem": "ketcher", "mol_block": "ketcher", "inchi": "ketcher"}),
    (5, 2, {"fasta_sequence": "biojs", "genbank_record": "biojs"}),
    (6, 3, {"pdb_protein": "3dmol", "cif_crystal": "3dmol"}),
    (7, 2, {"circuit_schematic": "svg", "logic_gate": None}),
    (8, 2, {"block_diagram": "plotly", "bode_plot": "plotly"}),
    (9, 1, {"code_snippet": "shiki", "ast_tree": "shiki"}),
    (10, 1, {"flowchart": "mermaid", "state_machine": "mermaid", "tree": None}),
    (11, 2, {"network_topology": "mermaid", "packet_frame": "mermaid"}),
    (12, 3, {"cad_3d_model": "three", "point_cloud": "three"}),
    (13, 1, {"technical_blueprint": "svg", "iso_cut": "svg"}),
    (14, 3, {"bim_ifc_slice": "web-ifc", "floorplan_2d": "web-ifc"}),
    (15, 3, {"geojson_map": "maplibre", "topography_layer": "maplibre"}),
    (16, 2, {"geological_strata": "plotly", "well_log": "plotly"}),
    (17, 3, {"isobar_map": "plotly", "wind_rose": "plotly"}),
    (18, 2, {"signal_waveform": "plotly", "spectrum_fft": "plotly"}),
    (19, 2, {"ray_tracing": "plotly", "optical_spectrum": "plotly"}),
    (20, 2, {"feynman_diagram": "svg", "decay_chain": "svg"}),
    (21, 1, {"dense_illustration": "openseadragon", "histology_cut": "openseadragon"}),
    (22, 3, {"dicom_slice": "openseadragon", "xray_image": "openseadragon"}),
    (23, 2, {"sheet_music": "vexflow", "tablature": "abcjs"}),
    (24, 2, {"phonetic_tree": "svg", "hieroglyph_vector": "svg"}),
    (25, 1, {"microscopy_photo": "img-loupe", "macro_sample": "img-loupe"}),
)
# Renderer to render family.
RENDERER_FAMILY = {
    "katex": "matrix", "svg": "geometry_vector", "mermaid": "flowchart", "plotly": "signal_waveform",
    "tanstack-table": "data_table", "shiki": "code_snippet", "ketcher": "smiles_chem",
    "openseadragon": "dense_illustration", "param-number-line": "number_line",
    "param-decimal-grid": "decimal_grid",
}
# Ordered substring tests on the artifact type.
TYPE_WORDS = (
    ("geometry_vector", ("geometry", "svg", "vector")),
    ("matrix", ("matrix", "latex", "formula", "equation", "math")),
    ("data_table", ("table",)),
    ("flowchart", ("flow", "mermaid")),
    ("signal_waveform", ("signal", "waveform", "plot", "chart")),
    ("smiles_chem", ("smiles", "chem", "mol")),
    ("code_snippet", ("code", "snippet")),
    ("dense_illustration", ("illustration", "image", "figure", "photo")),
)


def artifact_dim(spark: SparkSession) -> DataFrame:
    """The fixed dimension of artifact types (about fifty rows)."""
    rows = [
        (kind, number, tier, renderer, json.dumps(RENDER[renderer]) if renderer else None)
        for number, tier, kinds in FAMILIES
        for kind, renderer in kinds.items()
    ]
    return spark.createDataFrame(
        rows, "artifact_type string, family_no int, tier int, renderer string, render_config_json string"
    )


# ── model answers ──────────────────────────────────────────────────────────


def _first_object(text: str | None) -> str | None:
    """First balanced ``{…}`` of a text, if it is a JSON object."""
    begin = text.find("{") if text else -1
    if begin < 0:
        return None
    try:
        # raw_decode stops at the end of the first value, as a balanced scan does.
        value, _ = json.JSONDecoder(strict=True).raw_decode(text, begin)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def first_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_first_object)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    """A JSON string as is; any other JSON type is null."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _clean(v: Column, path: str) -> Column:
    text = strip(_string(v, path))
    return F.when(text != "", text)


def number_of(v: Column, path: str = "$") -> Column:
    """Finite number from a JSON number or numeric string; booleans refused."""
    kind = _kind(v, path)
    text = F.trim(F.try_variant_get(v, path, "string"))
    numeric = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(kind == "STRING", F.when(numeric, text.try_cast("double"))).when(
        kind != "BOOLEAN", F.try_variant_get(v, path, "double")
    )
    return _let(value, lambda x: F.when(F.abs(x) < float("inf"), x))


@dataclass(frozen=True)
class Limits:
    """Bounds of model answers; None keeps everything.  Items past a bound are left out, longer
    labels and larger drawings refused."""

    points: int | None = None
    segments: int | None = None
    cells: int | None = None
    label_chars: int | None = None
    svg_bytes: int | None = None
    search_chars: int | None = None


UNBOUNDED = Limits()


def _first(items: Column, count: int | None) -> Column:
    return items if count is None else F.slice(items, 1, count)


def _label(v: Column, path: str, limits: Limits) -> Column:
    text = strip(_string(v, path))
    fits = F.lit(True) if limits.label_chars is None else F.length(text) <= limits.label_chars
    return F.when((text != "") & fits, text)


def _object(payload: Column) -> Column:
    """A payload given as object, or as JSON text of one."""
    as_text = F.try_parse_json(F.try_variant_get(payload, "$", "string"))
    obj = F.when(F.schema_of_variant(payload) == "STRING", as_text).otherwise(payload)
    return F.when(F.schema_of_variant(obj).startswith("OBJECT"), obj)


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _let(value: Column, use) -> Column:
    """Bind an expression once for several uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def valid_number_line(payload: Column, limits: Limits = UNBOUNDED) -> Column:
    """Normalised JSON of a graduated line, null when it breaks a rule."""
    read_point = lambda p: F.struct(_label(p, "$.label", limits).alias("label"), number_of(p, "$.value").alias("value"))

    def read(o: Column) -> Column:
        points = F.filter(_first(_items(o, "$.points"), limits.points), _is_object)
        pairs = F.filter(
            _first(_items(o, "$.highlight_segments"), limits.segments),
            lambda s: F.size(_items(s, "$")) == 2,
        )
        return F.struct(
            number_of(o, "$.min").alias("lo"), number_of(o, "$.max").alias("hi"), number_of(o, "$.step").alias("step"),
            F.transform(points, read_point).alias("points"),
            F.transform(pairs, lambda s: F.array(number_of(s, "$[0]"), number_of(s, "$[1]"))).alias("pairs"),
        )

    def check(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        points = F.filter(r["points"], lambda p: p["label"].isNotNull() & p["value"].between(lo, hi))
        pairs = F.filter(r["pairs"], lambda s: (s[0] >= lo) & (s[0] <= s[1]) & (s[1] <= hi))
        return F.struct(
            lo.alias("min"), hi.alias("max"), r["step"].alias("step"), points.alias("points"),
            F.when(F.size(pairs) > 0, pairs).alias("highlight_segments"),
        )

    def build(n: Column) -> Column:
        return F.when((n["min"] < n["max"]) & (n["step"] > 0) & (F.size(n["points"]) > 0), F.to_json(n))

    return _let(_let(_let(_object(payload), read), check), build)


def valid_decimal_grid(payload: Column, limits: Limits = UNBOUNDED) -> Column:
    """Normalised JSON of a coloured grid, null when it breaks a rule."""
    whole = lambda c: _let(c, lambda x: F.when(x == F.floor(x), x.cast("int")))
    read_cell = lambda c: F.struct(
        whole(number_of(c, "$.count")).alias("count"),
        F.lower(strip(_string(c, "$.color"))).alias("color"),
        _label(c, "$.label", limits).alias("label"),
    )

    def read(o: Column) -> Column:
        cells = F.filter(_first(_items(o, "$.cells"), limits.cells), _is_object)
        return F.struct(
            whole(number_of(o, "$.rows")).alias("rows"), whole(number_of(o, "$.cols")).alias("cols"),
            F.transform(cells, read_cell).alias("cells"),
        )

    def check(g: Column) -> Column:
        cells = F.filter(
            g["cells"],
            lambda c: c["count"].between(F.lit(0), g["rows"] * g["cols"]) & c["color"].isin(*GRID_COLORS),
        )
        return F.struct(g["rows"].alias("rows"), g["cols"].alias("cols"), cells.alias("cells"))

    def build(g: Column) -> Column:
        fits = g["rows"].between(1, MAX_GRID) & g["cols"].between(1, MAX_GRID) & (F.size(g["cells"]) > 0)
        return F.when(fits, F.to_json(g))

    return _let(_let(_let(_object(payload), read), check), build)


def valid_plotly(payload: Column) -> Column:
    return _let(_object(payload), lambda o: F.when(F.size(_items(o, "$.data")) > 0, F.to_json(o)))


def valid_svg(svg: Column, limits: Limits = UNBOUNDED) -> Column:
    found = svg.rlike(r"(?is)<svg\b[^>]*>.*</svg>")
    if limits.svg_bytes is not None:
        found = found & (F.octet_length(svg) < limits.svg_bytes)
    return F.coalesce(found, F.lit(False))


def semantic_of(v: Column) -> Column:
    low = F.lower(strip(_string(v, "$.semantic")))
    return F.when(low.isin(*SEMANTICS), low)


def map_answer(answer: Column, limits: Limits = UNBOUNDED) -> Column:
    """Model answer (JSON text) to ``struct<artifact_type,raw_data,
    render_config_json,caption,searchable_text,semantic>``; a null type keeps
    the dense illustration, a null struct means nothing usable."""

    def parsed(v: Column) -> Column:
        return F.struct(
            F.try_variant_get(v, "$.type", "string").alias("kind"),
            _clean(v, "$.caption_ar").alias("caption"),
            semantic_of(v).alias("semantic"),
            _clean(v, "$.latex").alias("latex"),
            _clean(v, "$.svg").alias("svg"),
            _clean(v, "$.mermaid").alias("mermaid"),
            _clean(v, "$.markdown").alias("markdown"),
            _clean(v, "$.smiles").alias("smiles"),
            _clean(v, "$.code").alias("code"),
            F.coalesce(_clean(v, "$.lang"), F.lit("text")).alias("lang"),
            valid_plotly(F.try_variant_get(v, "$.plotly_json", "variant")).alias("plotly"),
            valid_number_line(F.try_variant_get(v, "$.number_line", "variant"), limits).alias("line"),
            valid_decimal_grid(F.try_variant_get(v, "$.decimal_grid", "variant"), limits).alias("grid"),
        )

    def choose(p: Column) -> Column:
        kind, svg = p["kind"], valid_svg(p["svg"], limits)
        latex = F.concat(F.lit("$$"), sanitize_latex(p["latex"]), F.lit("$$"))
        # (condition, new type, payload, renderer), first match decides.
        branches = [
            ((kind == "number_line") & p["line"].isNotNull(), "number_line", p["line"], "param-number-line"),
            ((kind == "decimal_grid") & p["grid"].isNotNull(), "decimal_grid", p["grid"], "param-decimal-grid"),
            (kind.isin("geometry", "drawing") & svg, "geometry_vector", p["svg"], "svg"),
            ((kind == "diagram") & svg & p["mermaid"].isNull(), "geometry_vector", p["svg"], "svg"),
            (kind.isin("diagram", "flowchart") & p["mermaid"].isNotNull(), "flowchart", p["mermaid"], "mermaid"),
            (kind.isin("operation", "matrix") & p["latex"].isNotNull(), "matrix", latex, "katex"),
            ((kind == "plot") & p["plotly"].isNotNull(), "signal_waveform", p["plotly"], "plotly"),
            ((kind == "table") & p["markdown"].isNotNull(), "data_table", p["markdown"], "tanstack-table"),
            ((kind == "chemistry") & p["smiles"].isNotNull(), "smiles_chem", p["smiles"], "ketcher"),
            ((kind == "code") & p["code"].isNotNull(), "code_snippet", p["code"], "shiki"),
        ]
        new_type = payload = renderer = None
        for test, name, value, how in branches:
            new_type = (F if new_type is None else new_type).when(test, F.lit(name))
            payload = (F if payload is None else payload).when(test, value)
            renderer = (F if renderer is None else renderer).when(test, F.lit(how))
        return F.struct(p.alias("p"), new_type.alias("type"), payload.alias("raw"), renderer.alias("how"))

    def finish(c: Column) -> Column:
        p = c["p"]
        retyped = c["type"].isNotNull()
        search = strip(F.concat_ws(" ", F.coalesce(p["caption"], F.lit("")), c["raw"]))
        search = search if limits.search_chars is None else F.substring(search, 1, limits.search_chars)
        full = F.struct(
            c["type"].alias("artifact_type"),
            c["raw"].alias("raw_data"),
            render_config(F.coalesce(c["how"], F.lit("openseadragon")), p["lang"], p["semantic"], retyped)
            .alias("render_config_json"),
            p["caption"].alias("caption"),
            F.when(retyped, search).otherwise(p["caption"]).alias("searchable_text"),
            p["semantic"].alias("semantic"),
        )
        return F.when(retyped | p["caption"].isNotNull() | p["semantic"].isNotNull(), full)

    value = F.try_parse_json(answer)
    known = F.when(F.schema_of_variant(value).startswith("OBJECT"), value)
    return _let(_let(_let(known, parsed), choose), finish)


def render_config(renderer: Column, lang: Column, semantic: Column, retyped: Column) -> Column:
    """Render settings as JSON text; the semantic is an added key, and an
    untyped answer without semantic has no settings."""
    text = None
    for name, settings in RENDER.items():
        body = json.dumps(settings)[:-1]
        value = F.lit(body)
        if name == "shiki":
            head = json.dumps({k: v for k, v in settings.items() if k != "lang"})[:-1]
            value = F.concat(F.lit(head + ', "lang": '), F.to_json(F.array(lang)).substr(F.lit(2), F.length(F.to_json(F.array(lang))) - 2))
        text = (F if text is None else text).when(renderer == name, value)
    tail = F.when(semantic.isNotNull(), F.concat(F.lit(', "semantic": "'), semantic, F.lit('"}'))).otherwise("}")
    return F.when(retyped | semantic.isNotNull(), F.concat(text, tail))


def render_family(renderer: Column, artifact_type: Column) -> Column:
    """Declared renderer first, else the ordered substring tests."""
    low = F.lower(artifact_type)
    by_name = F.coalesce(*[F.when(F.lower(renderer) == k, v) for k, v in RENDERER_FAMILY.items()])
    by_type = None
    for family, words in TYPE_WORDS:
        by_type = (F if by_type is None else by_type).when(low.rlike("|".join(words)), family)
    return F.coalesce(by_name, by_type, F.lit("other"))


# ── geometry ───────────────────────────────────────────────────────────────


def bbox_of(json_text: Column) -> Column:
    return F.from_json(json_text, "x0 double, y0 double, x1 double, y1 double")


def raw_area_ratio(bbox: Column, width: Column, height: Column) -> Column:
    """Box area over page area, null when it cannot be computed."""
    w, h = bbox["x1"] - bbox["x0"], bbox["y1"] - bbox["y0"]
    page = width.cast("double") * height.cast("double")
    return F.when((w > 0) & (h > 0) & (page > 0), w * h / page)


def area_ratio(bbox: Column, width: Column, height: Column) -> Column:
    ratio = raw_area_ratio(bbox, width, height)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), 3) + F.when(ratio.isNull(), None).otherwise(0.0)


def strict_area_ratio(bbox: Column, width: Column, height: Column) -> Column:
    """As above, unknown counting as a full page."""
    return F.coalesce(raw_area_ratio(bbox, width, height), F.lit(1.0))
