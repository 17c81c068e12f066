"""Cross-section properties as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flanges(kind: Column, w: Column, t: Column, tf: Column | None, wb: Column | None, tb: Column | None) -> tuple[Column, Column, Column]:
    """Thickness of the top flange, width and thickness of the bottom one: t, w and the top flange's where not given, none below a tee."""
    top = t if tf is None else F.coalesce(tf, t)
    below = top if tb is None else F.coalesce(tb, top)
    return top, (w if wb is None else F.coalesce(wb, w)), F.when(kind == "tee", 0.0).otherwise(below)


def area(kind: Column, h: Column, w: Column, t: Column, tf: Column | None = None, wb: Column | None = None, tb: Column | None = None) -> Column:
    """Steel area of box, tube, bar, round, i, tee, angle and channel sections; poly has none (0) and others are null.

    h of a tube or round is its outer diameter. t is the web's thickness; tf the (top) flange's, wb and tb width and thickness of an i's bottom flange.
    An angle's w and tf are of its one flange. A box has two webs; its flanges are as thick as these where tf isn't given.
    """
    tf, wb, tb = _flanges(kind, w, t, tf, wb, tb)
    return (
        F.when(kind == "box", w * tf + wb * tb + 2 * t * (h - tf - tb))
        .when(kind == "tube", math.pi / 4 * (h * h - (h - 2 * t) * (h - 2 * t)))
        .when(kind == "bar", h * w)
        .when(kind == "round", math.pi / 4 * h * h)
        .when(kind.isin("i", "tee"), w * tf + t * (h - tf - tb) + wb * tb)
        .when(kind == "angle", t * (h - tf) + w * tf)
        .when(kind == "channel", 2 * w * tf + t * (h - 2 * tf))
        .when(kind == "poly", 0.0)
    )


def inertia(kind: Column, h: Column, w: Column, t: Column, tf: Column | None = None, wb: Column | None = None, tb: Column | None = None) -> Column:
    """Second moment of area about the strong axis; of angles and unequal flanges about the axis through the centroid, parallel to the flanges."""
    def cube(x: Column) -> Column:
        return x * x * x

    def fourth(x: Column) -> Column:
        return x * x * x * x

    def stacked(*parts: tuple[Column, Column, Column]) -> Column:
        """Of rectangles: width, height and level of the middle."""
        size = sum((b * d for b, d, _ in parts[1:]), parts[0][0] * parts[0][1])
        level = sum((b * d * z for b, d, z in parts[1:]), parts[0][0] * parts[0][1] * parts[0][2]) / size
        own = [b * cube(d) / 12 + b * d * (z - level) * (z - level) for b, d, z in parts]
        return sum(own[1:], own[0])

    tf, wb, tb = _flanges(kind, w, t, tf, wb, tb)
    return (
        F.when(kind == "box", stacked((w, tf, h - tf / 2), (2 * t, h - tf - tb, tb + (h - tf - tb) / 2), (wb, tb, tb / 2)))
        .when(kind == "tube", math.pi / 64 * (fourth(h) - fourth(h - 2 * t)))
        .when(kind == "bar", w * cube(h) / 12)
        .when(kind == "round", math.pi / 64 * fourth(h))
        .when(kind.isin("i", "tee"), stacked((w, tf, h - tf / 2), (t, h - tf - tb, tb + (h - tf - tb) / 2), (wb, tb, tb / 2)))
        .when(kind == "angle", stacked((t, h - tf, tf + (h - tf) / 2), (w, tf, tf / 2)))
        .when(kind == "channel", stacked((w, tf, h - tf / 2), (t, h - 2 * tf, h / 2), (w, tf, tf / 2)))
        .when(kind == "poly", 0.0)
    )


def simple_beam(load: Column, length: Column, x: Column, e_mod: Column, inertia: Column) -> tuple[Column, Column, Column]:
    """Shear, moment and deflection at x of a simply supported beam under an even load."""
    shear = load * (length / 2 - x)
    moment = load * x / 2 * (length - x)
    deflection = load * x / (24 * e_mod * inertia) * (length * length * length - 2 * length * x * x + x * x * x)
    return shear, moment, deflection


def weak_inertia(kind: Column, h: Column, w: Column, t: Column, tf: Column | None = None, wb: Column | None = None, tb: Column | None = None) -> Column:
    """Second moment of area about the weak axis, through the centroid and parallel to the web; poly has none (0) and others are null."""
    top, wide, below = _flanges(kind, w, t, tf, wb, tb)
    web = h - top - below

    def cube(x: Column) -> Column:
        return x * x * x

    def aside(*parts: tuple[Column, Column, Column]) -> Column:
        """Of rectangles: width, height and place of the middle."""
        size = sum((b * d for b, d, _ in parts[1:]), parts[0][0] * parts[0][1])
        place = sum((b * d * y for b, d, y in parts[1:]), parts[0][0] * parts[0][1] * parts[0][2]) / size
        own = [d * cube(b) / 12 + b * d * (y - place) * (y - place) for b, d, y in parts]
        return sum(own[1:], own[0])

    hollow = h - 2 * t
    return (
        F.when(kind == "box", (top * cube(w) + below * cube(wide) + 2 * web * cube(t)) / 12 + web * t * (w - t) * (w - t) / 2)
        .when(kind == "tube", math.pi / 64 * (h * h * h * h - hollow * hollow * hollow * hollow))
        .when(kind == "bar", h * cube(w) / 12)
        .when(kind == "round", math.pi / 64 * h * h * h * h)
        .when(kind.isin("i", "tee"), (top * cube(w) + web * cube(t) + below * cube(wide)) / 12)
        .when(kind == "angle", aside((t, h - top, t / 2), (w, top, w / 2)))
        .when(kind == "channel", aside((t, h - 2 * top, t / 2), (w, 2 * top, w / 2)))
        .when(kind == "poly", 0.0)
    )


#: Names of the twenty properties: area, torsion and second moments, least moduli, shear areas, shear centre's offset, static moments, shear factors, centre and centroid from the lower corner.
PROPERTIES = ("ax", "ix", "iy", "iz", "iyz", "wxmin", "wymin", "wzmin", "shary", "sharz", "shceny", "shcenz", "sy", "sz", "sfy", "sfz", "cy", "cz", "cgy", "cgz")


def properties(kind: Column, h: Column, w: Column, t: Column, tf: Column | None = None, wb: Column | None = None, tb: Column | None = None) -> Column:
    """The twenty PROPERTIES as a struct of doubles; null for kinds without (poly, profile, unknown ones) and for angles whose flange is thinner than the web.

    Dimensions as for `area`. Fixed values: the formulas of torsion, shear and static moments are those of the source's handbook, its peculiarities included (an i's sy is iy over half its width, a bar's cz its height, a box's torsion takes the web for the upper
    flange); area and second moments are `area`, `inertia` and `weak_inertia`.
    """
    own = (kind, h, w, t, tf, wb, tb)
    ax, iy, iz = area(*own), inertia(*own), weak_inertia(*own)
    top, wide, low = _flanges(kind, w, t, tf, wb, tb)
    # a tee's foot counts as a flange as wide as the web and as thick as the other
    wide, low = F.when(kind == "tee", t).otherwise(wide), F.when(kind == "tee", top).otherwise(low)
    web, zero, one = h - top - low, F.lit(0.0), F.lit(1.0)

    def of(shape: dict[str, Column]) -> Column:
        got = {"ax": ax, "iy": iy, "iz": iz, "iyz": zero, "shceny": zero, "shcenz": zero, "sfy": one, "sfz": one} | shape
        got = {"cgy": got["cy"], "cgz": got["cz"]} | got
        return F.struct(*(got[n].cast("double").alias(n) for n in PROPERTIES))

    # box: level of the centroid, and the middle lines' rectangle
    level = (w * low * low / 2 + w * top * (h - top / 2) + 2 * t * web * (low + web / 2)) / ax
    high, broad = h - (low + top) / 2, w - t
    box_x = 4 * high * high * broad * broad / (broad / low + broad / t + 2 * high / t)
    box_sy, box_sz = w * low * (level - low / 2) + t * (level - low) * (level - low), (low + top) * w * w / 8 + t * web * broad / 2
    box = {
        "ix": box_x, "wxmin": box_x * (broad + high) / (high * broad), "wymin": iy / F.greatest(h - level, level), "wzmin": 2 * iz / w, "sy": box_sy, "sz": box_sz, "shary": iz / box_sz * 2 * t, "sharz": iy / box_sy * 2 * t,
        "shcenz": h - top / 2 - level - low * high / (low + top), "cy": w / 2, "cz": level,
    }
    # i and tee
    mean = (w * top * (h - top / 2) + t * web * (low + web / 2) + wide * low * low / 2) / ax
    even = (top == t) & (top == low)
    i_x = F.when(even, top * top * top * (web + w + wide - 1.2 * top) / 3).otherwise(1.3 * (w * top * top * top + web * t * t * t + wide * low * low * low) / 3)
    i_sy, i_sz = iy / (w / 2), (top * w * w + low * wide * wide + web * t * t) / 8
    bars = top * w * w * w, low * wide * wide * wide
    beam = {
        "ix": i_x, "wxmin": i_x / F.when(even, top).otherwise(F.greatest(top, t, low)), "wymin": iy / F.greatest(h - mean, mean), "wzmin": 2 * iz / F.greatest(wide, w), "sy": i_sy, "sz": i_sz, "shary": iz / i_sz * (low + top), "sharz": iy / i_sy * t,
        "shcenz": ((h - top / 2) * bars[0] + low * bars[1] / 2) / (bars[0] + bars[1]) - mean, "cy": wide / 2, "cz": mean,
    }
    # tube and round; a round one has the static moment of a tube of 99 % of its radius
    inner = F.when(kind == "tube", h - 2 * t).otherwise(0.01 * h)
    ring = (h * h * h - inner * inner * inner) / 12
    thick = (h - inner) / 2
    tube = {"ix": 2 * iy, "wxmin": 4 * iy / h, "wymin": 2 * iy / h, "wzmin": 2 * iz / h, "sy": ring, "sz": ring, "shary": 2 * iz * thick / ring, "sharz": 2 * iy * thick / ring, "cy": zero, "cz": zero}
    # bar: b as it is compared with the height
    b = 2 * w * h * h / (h * h + ax * ax)
    lean = F.greatest(b, h) / F.least(b, h)
    ca = (1 - 0.63 / lean + 0.052 / F.pow(lean, 5)) * 3
    cb = ca / (1 - 0.63 / (1 + lean * lean * lean))
    bar = {
        "ix": F.when(h == b, 0.141 * F.pow(h, 4)).when(h < b, ca * b * h * h * h).otherwise(ca * h * b * b * b), "wxmin": F.when(h == b, 0.208 * h * h * h).when(h < b, cb * b * h * h).otherwise(cb * h * b * b * b),
        "wymin": 2 * iy / h, "wzmin": 2 * iz / w, "sy": w * h * h / 8, "sz": h * w * w / 8, "shary": 8 * iz / (w * w), "sharz": 8 * iy / (h * h), "cy": w / 2, "cz": h,
    }
    # angle: y and z of the centroid, from the web's and the flange's outer faces
    leg = h - top
    y, z = (leg * t * t + top * w * w) / (2 * ax), (leg * t * (top - leg / 2) + top * w * top / 2) / ax
    far, past = leg + top - z, w - y
    fall, aside = z - top / 2, y - t / 2
    l_x = (w * top * top * top + leg * t * t * t) / 3
    l_sy, l_sz = t * far * far / 2, top * past * past / 2
    angle = {
        "ix": l_x, "iyz": fall * top / 2 * (y * y - past * past) - aside * t / 2 * (far * far - (leg - far) * (leg - far)), "wxmin": l_x / (2 * (t + top - F.sqrt(2 * t * top))), "wymin": iy / F.greatest(z, h - leg), "wzmin": iz / F.greatest(y, past),
        "sy": l_sy, "sz": l_sz, "shary": iz * top / l_sz, "sharz": iy * top / l_sy, "shceny": -aside, "shcenz": -fall, "cy": y, "cz": z, "cgy": y, "cgz": (leg * t * (top + leg / 2) + top * w * top / 2) / ax,
    }
    # channel
    clear = h - 2 * top
    heel = (2 * top * w * w + clear * t * t) / (2 * ax)
    c_x = F.when(top == t, t * t * t * (2 * w + clear - 2.6 * t) / 3).otherwise(1.12 * (2 * w * top * top * top + clear * t * t * t) / 3)
    c_sy, c_sz = w * top * (top + clear) / 2 + t * clear * clear / 8, top * (w - heel) * (w - heel)
    arm = w - t / 2
    out = F.when(top == t, arm * arm * (h - top) * (h - top) * top / 4 * iy).otherwise(arm * arm * top / (2 * arm * top + (h - top) * t / 3))
    channel = {
        "ix": c_x, "wxmin": c_x / F.when(top == t, iy).otherwise(F.greatest(top, t)), "wymin": 2 * iy / h, "wzmin": iz / F.greatest(w - heel, heel), "sy": c_sy, "sz": c_sz, "shary": iz / c_sz * 2 * top, "sharz": iy / c_sy * t,
        "shceny": -(heel - t / 2 + out), "cy": w - heel, "cz": h / 2, "cgy": heel, "cgz": h / 2,
    }
    return (
        F.when(kind == "box", of(box)).when(kind.isin("i", "tee"), of(beam)).when(kind.isin("tube", "round"), of(tube)).when(kind == "bar", of(bar)).when((kind == "angle") & (top >= t), of(angle)).when(kind == "channel", of(channel))
    )


#: How section texts begin, in the order in which they are tried, and which numbers of the text are height, width, web and flange.
_NUMBER = r"([0-9]*\.?[0-9]+)"
TEXT_FORMS = (
    ("box", ("BOX", "BG", "CG"), 4, (1, 2, 3, 4), 1.0),
    ("box", ("SHS",), 2, (1, 1, 2, 2), 1.0),
    ("box", ("URHS", "RHS"), 3, (1, 2, 3, 3), 1.0),
    ("i", ("IG",), 4, (1, 2, 3, 4), 1.0),
    ("tee", ("TG", "T"), 4, (1, 2, 3, 4), 1.0),
    ("tube", ("OD",), 2, (1, None, 2, None), 1.0),
    ("tube", ("TUB", "PIPE", "P"), 2, (1, None, 2, None), 2.0),
    ("angle", ("L",), 3, (1, 2, 3, 3), 1.0),
    ("angle", ("L",), 2, (1, 1, 2, 2), 1.0),
    ("bar", ("FB",), 2, (1, 2, None, None), 1.0),
    ("round", ("CIRC",), 1, (1, None, None, None), 2.0),
)
#: Heads of rolled profiles with the size that follows.
PROFILES = (("HEA", "HEB", "HEM", "IPE", "UNP"), r"[0-9]+"), (("HP",), r"[0-9]+x[0-9]+")


def from_text(text: Column, scale: float = 0.001) -> Column:
    """kind, h, w, t, tf and profile of a section text such as BG200x150x10x12; the first form that fits is taken, by any case.

    Numbers are in units of `scale`. The first number of TUB, PIPE, P and CIRC is a radius, that of OD a diameter; h is the diameter. An angle has one thickness, and one leg where it has two numbers (L100x8). A rolled profile (IPE200,
    HE200B as HEB200, HP180x10, UNP180 of UNP180x10) has kind profile and its name, for a join with a table of profiles; a text of no form has kind null.
    """
    out = None
    none, no_name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for kind, heads, n, places, times in TEXT_FORMS:
        pattern = rf"(?i)^(?:{'|'.join(heads)})" + "x".join([_NUMBER] * n)
        number = [None if p is None else F.regexp_extract(text, pattern, p).try_cast("double") * scale for p in places]
        number[0] = number[0] * times
        found = F.struct(F.lit(kind).alias("kind"), *((none if v is None else v).alias(c) for c, v in zip(("h", "w", "t", "tf"), number, strict=True)), no_name.alias("profile"))
        out = F.when(text.rlike(pattern), found) if out is None else out.when(text.rlike(pattern), found)

    def rolled(fits: Column, name: Column) -> Column:
        return out.when(fits, F.struct(F.lit("profile").alias("kind"), *(none.alias(c) for c in ("h", "w", "t", "tf")), name.alias("profile")))

    for heads, size in PROFILES:
        pattern = rf"(?i)^(?:{'|'.join(heads)}){size}"
        out = rolled(text.rlike(pattern), F.regexp_replace(F.upper(F.regexp_extract(text, pattern, 0)), "(?<=[0-9])X", "x"))
    swapped = r"(?i)^HE([0-9]+)([ABM])"
    out = rolled(text.rlike(swapped), F.upper(F.concat(F.lit("HE"), F.regexp_extract(text, swapped, 2), F.regexp_extract(text, swapped, 1))))
    return out.otherwise(F.struct(no_name.alias("kind"), *(none.alias(c) for c in ("h", "w", "t", "tf")), no_name.alias("profile")))


def load_vector(dof: Column, magnitude: Column, angle: Column) -> Column:
    """Force in global axes: the local direction (nulls as 0) times the magnitude, turned by `angle` about z."""
    local = F.transform(dof, lambda d: F.coalesce(d, F.lit(0.0)) * magnitude)
    x, y, z = (F.get(local, F.lit(i)) for i in range(3))
    return F.array(x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle), z)
