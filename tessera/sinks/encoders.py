"""Serialisation of curve scenes to SVG, PDF, EPS and DXF, geometry-free envelopes, and PAM for decoded pixels.

Numbers have six digits behind the point. y is turned round for PDF and EPS; these two are always black.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Commands = list[tuple]
Layers = list[tuple[tuple[int, int, int], list[Commands]]]
FORMATS = ("svg", "pdf", "eps", "dxf")
#: The name in the comment line of a PDF; a parameter of the layout.
PRODUCER = "Tessera"


def number(v: float) -> str:
    return f"{v:.6f}"


def path_data(commands: Commands) -> str:
    return " ".join(" ".join([name, *map(number, v)]) for name, *v in commands)


def svg(width: int, height: int, paths: list[Commands], layers: Layers = (), fill: tuple[int, int, int] = (0, 0, 0)) -> str:
    rows = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">']
    for color, own in layers or [(fill, paths)]:
        data = " ".join(map(path_data, own))
        rows.append(f'  <path d="{data}" fill="#{bytes(color).hex()}" fill-rule="evenodd"/>')
    return "\n".join([*rows, "</svg>", ""])


_POSTSCRIPT = {"M": "moveto", "L": "lineto", "C": "curveto", "Z": "closepath"}
_PDF = {"M": "m", "L": "l", "C": "c", "Z": "h"}


def _page(paths: list[Commands], height: int, names: dict[str, str]) -> str:
    rows = []
    for commands in paths:
        for name, *v in commands:
            turned = [number(height - x) if k % 2 else number(x) for k, x in enumerate(v)]
            rows.append(" ".join([*turned, names[name]]) + "\n")
    return "".join(rows)


def eps(width: int, height: int, paths: list[Commands]) -> str:
    head = f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 {width} {height}\n%%LanguageLevel: 2\n%%Pages: 1\n%%EndComments\nnewpath\n"
    return head + _page(paths, height, _POSTSCRIPT) + "0 0 0 setrgbcolor\neofill\nshowpage\n%%EOF\n"


def pdf(width: int, height: int, paths: list[Commands], producer: str = PRODUCER) -> str:
    stream = "q\n0 0 0 rg\n" + _page(paths, height, _PDF) + "f*\nQ\n"
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << >> /Contents 4 0 R >>",
        f"<< /Length {len(stream)} >>\nstream\n{stream}endstream",
    ]
    text, places = f"%PDF-1.7\n% {producer} geometry export\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(text))
        text += f"{k} 0 obj\n{body}\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    size = len(objects) + 1
    return f"{text}xref\n0 {size}\n0000000000 65535 f \n{table}trailer\n<< /Size {size} /Root 1 0 R >>\nstartxref\n{len(text)}\n%%EOF\n"


def _groups(*pairs: tuple[int, object]) -> str:
    """DXF group codes and values, each on a line."""
    return "".join(f"{code}\n{value}\n" for code, value in pairs)


def _point(x: tuple[int, float], y: tuple[int, float], z: int) -> list[tuple[int, str]]:
    return [(x[0], number(x[1])), (y[0], number(y[1])), (z, number(0.0))]


def dxf(width: int, height: int, paths: list[Commands]) -> str:
    line = lambda a, b: _groups((0, "LINE"), (8, 0), *_point((10, a[0]), (20, a[1]), 30), *_point((11, b[0]), (21, b[1]), 31))
    rows = []
    for commands in paths:
        now = first = None
        for name, *v in commands:
            end = tuple(v[-2:]) if v else first
            if name == "M":
                first = end
            elif name == "L" and now is not None:
                rows.append(line(now, end))
            elif name == "C" and now is not None:
                knots = [(40, number(k)) for k in (0, 0, 0, 0, 1, 1, 1, 1)]
                points = [p for q in (now, v[0:2], v[2:4], v[4:6]) for p in _point((10, q[0]), (20, q[1]), 30)]
                rows.append(_groups((0, "SPLINE"), (8, 0), (70, 8), (71, 3), (72, 8), (73, 4), (74, 0), *knots, *points))
            elif name == "Z" and now is not None and now != first:
                rows.append(line(now, first))
            now = end
    head = _groups((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1015"), (9, "$EXTMIN"), (10, 0), (20, 0), (9, "$EXTMAX"), (10, width), (20, height), (0, "ENDSEC"))
    return head + _groups((0, "SECTION"), (2, "ENTITIES")) + "".join(rows) + _groups((0, "ENDSEC"), (0, "EOF"))


def encode(form: str, width: int, height: int, paths: list[Commands], layers: Layers = (), fill: tuple[int, int, int] = (0, 0, 0)) -> tuple[str, bytes]:
    """(error, bytes) of a scene in one of the formats."""
    if form not in FORMATS:
        return "InvalidRequest", b""
    if not width or not height or not paths or any(not p or p[0][0] != "M" for p in paths):
        return "InvalidStructure", b""
    text = svg(width, height, paths, layers, fill) if form == "svg" else {"pdf": pdf, "eps": eps, "dxf": dxf}[form](width, height, paths)
    return "None", text.encode()


def envelope(form: Column, width: Column, height: Column, producer: str = PRODUCER) -> Column:
    """The export without geometry of each format, as text."""
    w, h = width.cast("string"), height.cast("string")
    return (
        F.when(form == "svg", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">\n</svg>\n')))
        .when(form == "pdf", F.concat(F.lit(f"%PDF-1.7\n% {producer} canonical export\n% width="), w, F.lit(" height="), h, F.lit("\n%%EOF\n")))
        .when(form == "eps", F.concat(F.lit("%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 "), w, F.lit(" "), h, F.lit("\n%%EOF\n")))
        .when(form == "dxf", F.concat(F.lit("0\nSECTION\n2\nHEADER\n9\n$EXTMAX\n10\n"), w, F.lit("\n20\n"), h, F.lit("\n0\nENDSEC\n0\nEOF\n")))
    )


def pam(width: Column, height: Column, rgba: Column) -> Column:
    """A P7 file of RGBA bytes."""
    head = F.concat(F.lit("P7\nWIDTH "), width.cast("string"), F.lit("\nHEIGHT "), height.cast("string"), F.lit("\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"))
    return F.concat(head.cast("binary"), rgba)


def certificate(schema: str, name: str, input_sha: str, output_sha: str, revision: str, samples: int, units: int, metrics: list[tuple[str, float, float, float]]) -> bytes:
    """The canonical text of a quality certificate; metrics are (name, measured, minimum, maximum) in order of name."""
    pairs = [("schema_version", schema), ("certificate_id", name), ("input_sha256", input_sha), ("output_sha256", output_sha)]
    pairs += [("toolchain_revision", revision), ("sample_count", samples), ("execution_units", units)]
    for k, (metric, *values) in enumerate(metrics):
        pairs.append((f"metric[{k}].name", metric))
        pairs += [(f"metric[{k}].{n}", f"{v:.17g}") for n, v in zip(("measured", "minimum", "maximum"), values, strict=True)]
    return "".join(f"{k}={v}\n" for k, v in pairs).encode()
