"""Fixed reference tables and the column expressions generated from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """An archaeological period; a date belongs when bp_end < mid <= bp_start."""

    key: str
    label: str
    bp_start: float
    bp_end: float
    keywords: tuple[str, ...] = field(default=())


# Periods in order, bounds in years BP, lower-case keywords.
PERIODS: tuple[Period, ...] = (
    Period("EBA", "Early Bronze Age", 4000, 3500, ("lower xiajiadian", "xiajiadian (lower", "erlitou", "xia dynasty", "proto-shang")),
    Period("LBA", "Late Bronze Age", 3500, 2800, ("upper xiajiadian", "shang dynasty", "western zhou", "shang to zhou", "bronze age (late)", "weiyingzi")),
    Period("EIA", "Early Iron Age", 2800, 2200, ("spring and autumn", "warring states", "eastern zhou", "zhou dynasty", "early iron age", "yankovskaia", "paleometal", "baijinbao", "백금보")),
    Period(
        "HAN",
        "Han and Buyeo",
        2200,
        1700,
        ("han dynasty", "qin to han", "western han", "eastern han", "qin dynasty", "fuyu", "buyeo", "부여", "han commandery", "xiongnu", "흉노", "polsetskaia", "폴체"),
    ),
    Period(
        "GOG",
        "Goguryeo and Xianbei",
        1700,
        1300,
        ("xianbei", "선비", "wei to jin", "northern wei", "jin dynasty (265", "sanyan", "goguryeo", "koguryo", "고구려", "sixteen kingdoms", "tuoba"),
    ),
    Period(
        "BHL",
        "Balhae to Liao",
        1300,
        700,
        ("bohai", "balhae", "발해", "liao to jin", "liao dynasty", "liao jin", "jin dynasties", "tang dynasty", "khitan", "jurchen", "여진", "malgal", "말갈", "mongol empire", "몽골"),
    ),
)

# Zones in order of priority, lon_min, lat_min, lon_max, lat_max, inclusive.
ZONES: tuple[tuple[str, float, float, float, float], ...] = (
    ("연해주", 130, 42, 140, 49),
    ("아무르·하바롭스크", 125, 49, 141, 56),
    ("길림·흑룡강", 122, 43, 135, 49),
    ("몽골·자바이칼", 100, 44, 122, 56),
    ("요서·내몽골동부", 115, 40, 122, 45),
    ("요동·요동반도", 120, 38, 126, 43),
    ("화북", 105, 33, 120, 40),
)

# Taxon groups in order with their names.
TAXA: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("돼지", ("pig", "piglet", "wild boar", "sus")),
    ("개", ("dog", "canis", "canis familiaris", "canis sp")),
    ("소", ("cattle", "aurochs", "bovini", "water buffalo", "bos", "cattle/water buffalo")),
    ("양·염소", ("sheep", "goat", "sheep/goat", "caprine", "ovis", "capra")),
    ("말", ("horse", "equus")),
    ("사슴", ("deer", "red deer", "sika deer", "roe deer", "water deer", "cervus", "elk", "moose")),
    ("사람", ("human", "homo sapien", "homo sapiens")),
)
OTHER_TAXON = "기타"
HUMAN_TAXON = "사람"
PIG_TAXON = "돼지"
ALL_TAXA = "전체"
ALL_ANIMALS = "전체동물"

# Region centroids, lat, lon.
REGION_CENTROIDS: dict[str, tuple[float, float]] = {
    "primorye": (43.5, 132.0),
    "amur": (50.3, 127.5),
    "transbaikal": (51.5, 107.5),
    "transbaika": (51.5, 107.5),
    "east mongolia": (47.5, 112.0),
    "north china": (38.0, 114.0),
    "liaoning": (41.5, 122.0),
    "inner mongolia": (43.0, 115.0),
    "jillin province": (43.5, 126.0),
    "jilin": (43.5, 126.0),
}

# Region spellings.
REGION_SPELLINGS: dict[str, str] = {
    "transbaika": "Transbaikal",
    "transbaikal": "Transbaikal",
    "primorye": "Primorye",
    "amur": "Amur",
    "east mongolia": "East Mongolia",
    "north china": "North China",
    "liaoning": "Liaoning",
    "inner mongolia": "Inner Mongolia",
    "jillin province": "Jilin",
    "jilin": "Jilin",
}

# Other names of sites.
SITE_ALIASES: dict[str, str] = {
    "체레파하13": "cherepakha 13",
    "체르냐찌노2": "chernyatino 2",
    "루스키1": "russkiy 1",
    "보스펠로보1": "pospelovo 1",
    "나지모바1": "nazimova 1",
    "russiky-1": "russkiy 1",
    "pospelovo i": "pospelovo 1",
    "nazimova i": "nazimova 1",
    "atsai ii": "atsai 2",
    "i'lmovaya pad'": "ilmovaya pad",
    "ilmovaya pad'": "ilmovaya pad",
    "ivolgin": "ivolga",
    "the bagou": "bagou",
    "the east wuzhuer": "dongwuzhuer",
    "lamadong site": "lamadong",
    "honghe  site": "honghe",
    "honghe site": "honghe",
    "weizili site": "weizili",
    "changshan site": "changshan",
    "troitsky cemeter": "troitsky",
    "troitsky cemetery": "troitsky",
}

# Endings of site names, in the order in which they are taken off.
SITE_SUFFIXES = ("site", "cemetery", "cemeter", "settlement", "tomb", "tombs", "burial", "group", "ruins")

# Quality labels of coordinate sources.
COORD_QUALITY = {"exact": "정확", "shapefile": "정확", "name_match": "이름대조", "manual": "수기입력", "approx": "지역근사"}
NO_QUALITY = "없음"

# Palaeoclimate slices, older and younger bound in ka, in order.
PALEO_SLICES: tuple[tuple[str, float, float], ...] = (
    ("LH", 4.2, 0.3),
    ("MH", 8.326, 4.2),
    ("EH", 11.7, 8.326),
    ("YDS", 12.9, 11.7),
    ("BA", 14.7, 12.9),
    ("HS1", 17.0, 14.7),
    ("LGM", 21.0, 21.0),
)
# Climate slices with their years BP, the palaeo ones first.
CLIMATE_SLICES: tuple[tuple[str, float], ...] = (("mid", 6000.0), ("lgm", 21000.0))
CURRENT_BP = -30.0
SCENARIO_ORDER = ("lgm", "mid", "current")

# Bioclimatic layers stored times ten in the 1.4 release.
SCALE10_BIOS = (1, 2, 4, 5, 6, 7, 8, 9, 10, 11)

# Least number of sites of each model.
MODEL_MIN_SITES: dict[str, int] = {"bioclim": 3, "mahalanobis": 4, "glm": 5, "gam": 8, "rf": 10, "brt": 15, "maxent": 5}

# Compass directions from north, clockwise.
DIRECTIONS = ("북", "북동", "동", "남동", "남", "남서", "서", "북서")


def period_order() -> Column:
    """A map from period key to its ordinal."""
    return F.create_map(*(x for i, p in enumerate(PERIODS) for x in (F.lit(p.key), F.lit(i))))


def period_table(spark: SparkSession, periods=PERIODS) -> DataFrame:
    """The periods as rows, with midpoint and calendar text."""
    rows = [(i, p.key, p.label, float(p.bp_start), float(p.bp_end), (p.bp_start + p.bp_end) / 2, calendar_text(p), list(p.keywords)) for i, p in enumerate(periods)]
    return spark.createDataFrame(rows, "ordinal int, key string, label string, bp_start double, bp_end double, bp_mid double, calendar string, keywords array<string>")


def calendar_text(period: Period) -> str:
    """`BCE n~CE n`; year 0 reads CE 0."""
    one = lambda bp: f"BCE {abs(int(1950 - bp))}" if 1950 - bp < 0 else f"CE {int(1950 - bp)}"
    return f"{one(period.bp_start)}~{one(period.bp_end)}"


def zone_table(spark: SparkSession, zones=ZONES) -> DataFrame:
    rows = [(i, n, float(a), float(b), float(c), float(d)) for i, (n, a, b, c, d) in enumerate(zones)]
    return spark.createDataFrame(rows, "priority int, zone string, lon_min double, lat_min double, lon_max double, lat_max double")


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_MIN_SITES.items()), "model string, min_sites int")


def first_case(branches) -> Column:
    """First matching (condition, value) of a list, else null; one CASE, no join."""
    out = None
    for condition, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(None).cast("string") if out is None else out
