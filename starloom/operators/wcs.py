"""Plate solutions: FITS keywords to solution properties and back, and which keywords belong to one.

Image coordinates of properties start at the top-left corner, y downward; those
of keywords count pixels of the bottom-up image from 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.sources.cards import format_double, quoted, unquoted

PREFIX = "PCL:AstrometricSolution:"
SPLINE = PREFIX + "SplineWorldTransformation:"
# Projection codes and the names that properties use; the last three are only written.
PROJECTIONS = {"TAN": "Gnomonic", "STG": "Stereographic", "ZEA": "ZenithalEqualArea", "SIN": "Orthographic", "ARC": "ZenithalEqualDistance", "MER": "Mercator", "CAR": "PlateCarree", "AIT": "HammerAitoff"}
READ = ("TAN", "STG", "ZEA", "SIN", "ARC")
#: Control points along the longer side, at most.
GRID = 24


def is_wcs_keyword(name: Column) -> Column:
    """Keywords of a world coordinate system: axes, matrices, projection and distortion terms, alternates among them."""
    n = F.upper(F.trim(name))
    plain = r"^(WCSAXES|WCSNAME|CTYPE\d|CUNIT\d|CRVAL\d|CRPIX\d|CDELT\d|CROTA\d|CD\d_\d|PC\d_\d|PV\d_\d+|PS\d_\d+|LONPOLE|LATPOLE|RADESYS|EQUINOX|CRDER\d|CSYER\d|SPECSYS|VELOSYS)[A-Z]?$"
    other = r"^(RADECSYS|EPOCH|PC00\d00\d|A_ORDER|B_ORDER|AP_ORDER|BP_ORDER|AP?_\d+_\d+|BP?_\d+_\d+|A_DMAX|B_DMAX|WAT\d_\d{3}|CPDIS\d|CQDIS\d|DP\d.*|DQ\d.*|D2IM.*|TR\d_\d+)$"
    return n.rlike(plain) | n.rlike(other)


def _powers(low: int, high: int) -> list[tuple[int, int]]:
    return [(p, n - p) for n in range(low, high + 1) for p in range(n, -1, -1)]


def _design(x: np.ndarray, y: np.ndarray, terms: list[tuple[int, int]]) -> np.ndarray:
    return np.stack([x**p * y**q for p, q in terms], axis=1)


def _numbers(cards: dict[str, str]) -> dict[str, float]:
    out = {}
    for k, v in cards.items():
        try:
            out[k] = float(v.strip().upper().replace("D", "E"))
        except ValueError:
            continue
    return out


def linear_part(n: dict[str, float]) -> np.ndarray | None:
    """The CD matrix, from CD, PC and CDELT, or CDELT and CROTA2; None if there is none or it has no inverse."""
    names = [f"{i}_{j}" for i in (1, 2) for j in (1, 2)]
    if any(f"CD{x}" in n for x in names):
        cd = np.array([n.get(f"CD{x}", 0.0) for x in names]).reshape(2, 2)
    elif "CDELT1" in n and "CDELT2" in n:
        scale = np.diag([n["CDELT1"], n["CDELT2"]])
        if any(f"PC{x}" in n for x in names) or "CROTA2" not in n:
            cd = scale @ np.array([n.get(f"PC{x}", float(x[0] == x[2])) for x in names]).reshape(2, 2)
        else:
            a = math.radians(n["CROTA2"])
            cd = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) @ scale
    else:
        return None
    return cd if abs(np.linalg.det(cd)) > 0 else None


def solution(cards: dict[str, str], width: int, height: int) -> tuple[list[tuple], str]:
    """(properties, note) of an image's keywords: (id, type, text, bytes, rows, columns); no properties with the reason why."""
    text = {k: unquoted(v).upper() for k, v in cards.items()}
    n = _numbers(cards)
    first, second = text.get("CTYPE1", ""), text.get("CTYPE2", "")
    if not first or not second:
        return [], ""
    code = first[5:8]
    if not first.startswith("RA--") or not second.startswith("DEC-"):
        return [], f"the axes are not right ascension and declination ({first}, {second})"
    if code not in READ or second[5:8] != code:
        return [], f"projection {code} has no solution"
    if any(text.get(k, "DEG").lower() not in ("deg", "degree", "degrees", "") for k in ("CUNIT1", "CUNIT2")):
        return [], "the axes are not in degrees"
    cd = linear_part(n)
    if cd is None or not all(k in n for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")):
        return [], "the keywords are incomplete or singular"
    down = np.diag([1.0, -1.0])
    m = cd @ down
    ref = np.array([n["CRPIX1"] - 0.5, height + 0.5 - n["CRPIX2"]])
    system = next((text[k] for k in ("RADESYS", "RADECSYS") if text.get(k)), "ICRS")
    out: list[tuple] = []

    def scalar(name: str, kind: str, value: str) -> None:
        out.append((name, kind, value, None, None, None))

    def array(name: str, values: np.ndarray) -> None:
        values = np.asarray(values, float)
        rows, columns = (values.shape[0], values.shape[1]) if values.ndim == 2 else (values.size, 0)
        out.append((name, "F64Matrix" if columns else "F64Vector", None, values.astype("<f8").tobytes(), rows, columns))

    scalar("Observation:CelestialReferenceSystem", "String", system if system in ("ICRS", "FK5", "FK4", "GCRS") else "ICRS")
    scalar("Observation:Equinox", "Float64", format_double(n.get("EQUINOX", 2000.0)))
    array(PREFIX + "CelestialPoleNativeCoordinates", [n.get("LONPOLE", 180.0), n.get("LATPOLE", 90.0)])
    array(PREFIX + "LinearTransformationMatrix", m)
    scalar(PREFIX + "ProjectionSystem", "String", PROJECTIONS[code])
    array(PREFIX + "ReferenceCelestialCoordinates", [n["CRVAL1"], n["CRVAL2"]])
    array(PREFIX + "ReferenceImageCoordinates", ref)
    array(PREFIX + "ReferenceNativeCoordinates", [0.0, 90.0])
    note = f"{PROJECTIONS[code]}, {math.sqrt(abs(np.linalg.det(cd))) * 3600:.3f} arcsec a pixel"
    orders = [int(n.get(k, 0)) for k in ("A_ORDER", "B_ORDER")]
    if first.endswith("-SIP") and all(2 <= o <= 9 for o in orders):
        # The distortion, sampled on a grid that includes the borders.
        terms = _powers(2, max(orders))
        a, b = (np.array([n.get(f"{k}_{p}_{q}", 0.0) for p, q in terms]) for k in "AB")
        count = [max(4, round((GRID - 1) * s / max(width, height)) + 1) for s in (width, height)]
        x, y = (g.reshape(-1) for g in np.meshgrid(np.linspace(0, width, count[0]), np.linspace(0, height, count[1])))
        d = np.stack([x + 0.5 - n["CRPIX1"], height + 0.5 - y - n["CRPIX2"]])
        poly = _design(d[0], d[1], terms)
        world = cd @ (d + np.stack([poly @ a, poly @ b]))
        array(SPLINE + "ControlPoints:Image", np.stack([x, y], axis=1).reshape(-1))
        array(SPLINE + "ControlPoints:World", world.T.reshape(-1))
        array(SPLINE + "LinearApproximation", np.c_[m, -m @ ref])
        for name, kind, value in (("RBFType", "String", "DDMThinPlateSpline"), ("SplineOrder", "Int32", "2"), ("SplineSmoothness", "Float32", "0"), ("UseSimplifiers", "Boolean", "false")):
            scalar(SPLINE + name, kind, value)
        note += f", {len(x)} control points"
    return out, note


def keywords(properties: dict[str, object], width: int, height: int, order: int = 4, bottom_up: bool = True) -> list[tuple[str, str]]:
    """Keywords of solution properties (texts and arrays by id); distortion as SIP terms of ``order``, kept only if they fit better.

    World coordinates are linear in all coefficients, so one least-squares fit
    gives the linear part and the terms of higher order together.
    """
    code = {v: k for k, v in PROJECTIONS.items()}.get(str(properties.get(PREFIX + "ProjectionSystem", "")))
    needed = [properties.get(PREFIX + k) for k in ("LinearTransformationMatrix", "ReferenceCelestialCoordinates", "ReferenceImageCoordinates")]
    if code is None or any(x is None for x in needed):
        return []
    m, sky, ref = (np.asarray(x, float) for x in needed)
    down = np.diag([1.0, -1.0])
    cd, pixel = m.reshape(2, 2) @ down, np.array([ref[0] + 0.5, height + 0.5 - ref[1]])
    at, world = properties.get(SPLINE + "ControlPoints:Image"), properties.get(SPLINE + "ControlPoints:World")
    sip: list[tuple[str, float]] = []
    if at is not None and world is not None and len(at) == len(world) >= 2 * len(_powers(1, order)):
        at, world = np.asarray(at, float).reshape(-1, 2), np.asarray(world, float).reshape(-1, 2)
        d = np.stack([at[:, 0] + 0.5 - pixel[0], height + 0.5 - at[:, 1] - pixel[1]], axis=1)
        unit = max(width, height) / 2  # powers of numbers near 1 keep the fit well conditioned
        straight = np.sqrt(np.mean((world - d @ cd.T) ** 2))
        terms = _powers(1, order)
        fit = np.linalg.lstsq(_design(d[:, 0] / unit, d[:, 1] / unit, terms), world, rcond=None)[0]
        rms = np.sqrt(np.mean((world - _design(d[:, 0] / unit, d[:, 1] / unit, terms) @ fit) ** 2))
        fit = fit / np.array([unit ** (p + q) for p, q in terms])[:, None]
        if rms < straight:
            cd = fit[:2].T
            bent = np.linalg.solve(cd, fit[2:].T)
            sip += [("A_ORDER", order), ("B_ORDER", order)]
            sip += [(f"{k}_{p}_{q}", c) for k, row in zip("AB", bent, strict=True) for (p, q), c in zip(terms[2:], row, strict=True)]
            u = np.linalg.solve(cd, world.T).T
            back = np.linalg.lstsq(_design(u[:, 0] / unit, u[:, 1] / unit, terms), d - u, rcond=None)[0] / np.array([unit ** (p + q) for p, q in terms])[:, None]
            sip += [("AP_ORDER", order), ("BP_ORDER", order)]
            sip += [(f"{k}P_{p}_{q}", c) for k, row in zip("AB", back.T, strict=True) for (p, q), c in zip(terms, row, strict=True)]
    pole = np.asarray(properties.get(PREFIX + "CelestialPoleNativeCoordinates", [180.0, 90.0]), float)
    tail = "-SIP" if sip else ""
    texts = [("CTYPE1", f"RA---{code}{tail}"), ("CTYPE2", f"DEC--{code}{tail}"), ("CUNIT1", "deg"), ("CUNIT2", "deg"), ("RADESYS", str(properties.get("Observation:CelestialReferenceSystem", "ICRS")))]
    numbers = [("EQUINOX", float(str(properties.get("Observation:Equinox", 2000)))), ("CRVAL1", sky[0]), ("CRVAL2", sky[1]), ("CRPIX1", pixel[0]), ("CRPIX2", pixel[1]), *((f"CD{i + 1}_{j + 1}", cd[i, j]) for i in (0, 1) for j in (0, 1)), ("LONPOLE", pole[0]), ("LATPOLE", pole[1]), *sip]
    made = [(k, quoted(v)) for k, v in texts] + [(k, str(int(v)) if k.endswith("_ORDER") else format_double(float(v)).upper()) for k, v in numbers]
    return made if bottom_up else flipped(made, height)


def flipped(cards: list[tuple[str, str]], height: int) -> list[tuple[str, str]]:
    """Keywords of one linear or SIP solution for rows in the other order."""
    has = any(k.startswith(("CD1", "CD2", "PC1", "PC2")) for k, _ in cards)
    out = []
    for k, v in cards:
        part = k.split("_")
        sip = part[0] in ("A", "B", "AP", "BP") and len(part) == 3 and part[2].isdigit()
        if k == "CRPIX2":
            v = format_double(height + 1 - float(v))
        elif k in ("CD1_2", "CD2_2", "PC1_2", "PC2_2") or k == "CDELT2" and not has or sip and (int(part[2]) % 2 == 1) != (part[0][0] == "B"):
            v = v[1:] if v.startswith("-") else v if float(v) == 0 else "-" + v.lstrip("+")
        out.append((k, v))
    return out


_PROPERTIES = "path string, image int, id string, type string, text string, data binary, rows bigint, columns bigint"


def solutions(cards: DataFrame, images: DataFrame) -> DataFrame:
    """Solution properties of ``cards(path, image, name, value)``, with ``images(path, image, width, height)``; one small group an image."""
    sized = cards.filter(is_wcs_keyword(F.col("name"))).select("path", "image", F.upper(F.trim("name")).alias("name"), "value").join(images.select("path", "image", "width", "height"), ["path", "image"])

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        rows, _ = solution(dict(zip(table["name"].to_pylist(), table["value"].to_pylist(), strict=True)), first["width"], first["height"])
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array([first["path"]] * len(rows), pa.string()), pa.array([first["image"]] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", "image", "id", "type", "text", "data", "rows", "columns"])

    return sized.groupBy("path", "image").applyInArrow(run, _PROPERTIES)


def solution_keywords(properties: DataFrame, images: DataFrame, order: int = 4, bottom_up: bool = True) -> DataFrame:
    """(path, image, name, value) of ``properties(path, image, id, text, data)``; one small group an image."""
    wanted = properties.filter(F.col("id").startswith(PREFIX) | F.col("id").isin("Observation:CelestialReferenceSystem", "Observation:Equinox"))
    sized = wanted.select("path", "image", "id", "text", "data").join(images.select("path", "image", "width", "height"), ["path", "image"])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values = {r["id"]: np.frombuffer(r["data"], "<f8") if r["data"] is not None else r["text"] for r in rows}
        made = keywords(values, rows[0]["width"], rows[0]["height"], order, bottom_up)
        return pa.table({"path": pa.array([rows[0]["path"]] * len(made), pa.string()), "image": pa.array([rows[0]["image"]] * len(made), pa.int32()), "name": pa.array([k for k, _ in made], pa.string()), "value": pa.array([v for _, v in made], pa.string())})

    return sized.groupBy("path", "image").applyInArrow(run, "path string, image int, name string, value string")


def merged_properties(carried: DataFrame, made: DataFrame, valid: DataFrame) -> DataFrame:
    """``carried(path, image, id, ...)`` with solutions that keywords made in their place.

    A carried solution stays only for the images in ``valid(path, image)``,
    whose digest still holds; what keywords made replaces what is carried.
    """
    stale = carried.filter(F.col("id").startswith(PREFIX)).join(valid.select("path", "image"), ["path", "image"], "left_anti")
    kept = carried.join(stale.select("path", "image", "id"), ["path", "image", "id"], "left_anti").join(made.select("path", "image", "id"), ["path", "image", "id"], "left_anti")
    return kept.unionByName(made, allowMissingColumns=True)
