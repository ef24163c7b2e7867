"""The measurement schema as data: categories, kinds, columns, headers, filters.

A *category* (radio, neighbor, pdsch, pusch) holds one *kind* for each
technology. Each category is one table below; a row says where a canonical
column comes from in the LTE export and in the NR export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The schema's version, the choice that stands for NULL, and the technologies.
SCHEMA_VERSION = 2
NULL_CHOICE = "__null__"
TECHNOLOGIES = ("LTE", "NR")

STRING, LONG, DOUBLE, FLAG, TIME = "string", "bigint", "double", "boolean", "timestamp_ntz"


@dataclass(frozen=True)
class Headers:
    """Accepted source headers in order of preference."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Constant:
    """A value that is the same on every row of a kind; None is a typed NULL."""

    value: object


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    lte: Headers | Constant
    nr: Headers | Constant

    def source(self, technology: str) -> Headers | Constant:
        return self.lte if technology == "LTE" else self.nr


def _h(*names: str) -> Headers:
    return Headers(names)


def _both(name: str, kind: str, *headers: str) -> Column:
    return Column(name, kind, Headers(headers), Headers(headers))


ABSENT = Constant(None)

# --- Fixed values: header names, column names, types and units of the exports ---

_COMMON = (
    _both("measured_at", TIME, "time", "timestamp"),
    _both("database_name", STRING, "database", "database_name"),
    _both("collection_name", STRING, "collection", "collection_name"),
    _both("latitude", DOUBLE, "latitude"),
    _both("longitude", DOUBLE, "longitude"),
    _both("operator_name", STRING, "operator", "operator_name"),
    _both("model", STRING, "model"),
)

_IDENTITY = (
    Column("technology", STRING, Constant("LTE"), Constant("NR")),
    _both("rat", STRING, "ran_configuration"),
    _both("band_number", LONG, "band_number", "band"),
    Column("pci", LONG, _h("pci_lte", "pci"), _h("pci_5g_nr", "pci_nr", "pci")),
    Column("ssb_index", LONG, ABSENT, _h("ssb_index")),
)

_DL_CHANNEL = Column("dl_channel_number", LONG, _h("dl_earfcn"), _h("dl_nrarfcn", "dl_nr_arfcn"))
_UL_CHANNEL = Column("ul_channel_number", LONG, _h("ul_earfcn"), _h("ul_nrarfcn", "ul_nr_arfcn"))
_DL_WIDTH = (
    _both("dl_bandwidth_mhz", DOUBLE, "dl_bandwidth"),
    _both("dl_bandwidth_aggregated_mhz", DOUBLE, "dl_bandwidth_aggregated"),
)
_UL_WIDTH = (
    _both("ul_bandwidth_mhz", DOUBLE, "ul_bandwidth"),
    _both("ul_bandwidth_aggregated_mhz", DOUBLE, "ul_bandwidth_aggregated"),
)
_CELL_TYPE = _both("cell_type", STRING, "cell_type")
_RSRP = Column("rsrp_dbm", DOUBLE, _h("rsrp"), _h("ssrsrp", "ss_rsrp"))
_RSRQ = Column("rsrq_db", DOUBLE, _h("rsrq"), _h("ssrsrq", "ss_rsrq"))
_NR_SINR = _h("sssinr", "ss_sinr")


def _spacing(name: str, nr_header: str) -> Column:
    return Column(name, LONG, Constant(15), _h(nr_header))


COLUMNS: dict[str, tuple[Column, ...]] = {
    "radio": (
        *_COMMON,
        *_IDENTITY,
        _DL_CHANNEL,
        _UL_CHANNEL,
        *_DL_WIDTH,
        *_UL_WIDTH,
        _spacing("dl_scs_khz", "dl_subcarrier_spacing"),
        _CELL_TYPE,
        _RSRP,
        _RSRQ,
        Column("rssi_dbm", DOUBLE, _h("rssi_lte", "rssi"), ABSENT),
        Column("sinr_db", DOUBLE, _h("sinr"), _NR_SINR),
    ),
    "neighbor": (
        *_COMMON,
        *_IDENTITY,
        _DL_CHANNEL,
        _UL_CHANNEL,
        _spacing("dl_scs_khz", "dl_subcarrier_spacing"),
        Column("is_serving_beam", FLAG, ABSENT, _h("is_serving_beam")),
        _RSRP,
        _RSRQ,
        Column("rssi_dbm", DOUBLE, _h("rssi"), ABSENT),
        Column("sinr_db", DOUBLE, ABSENT, _NR_SINR),
    ),
    "pdsch": (
        *_COMMON,
        *_IDENTITY,
        _DL_CHANNEL,
        *_DL_WIDTH,
        _spacing("dl_scs_khz", "pdsch_scs"),
        _CELL_TYPE,
        Column(
            "throughput_mbps",
            DOUBLE,
            _h("lte_net_pdsch_throughput"),
            _h("5g_nr_net_pdsch_throughput"),
        ),
        _both("mcs", DOUBLE, "mcs"),
        _both("avg_pdsch_layers", DOUBLE, "avg_pdsch_layers"),
        _both("pdsch_rbs", DOUBLE, "pdsch_rbs"),
        Column("bler", DOUBLE, _h("bler"), _h("pdsch_bler")),
        _both("modulation", STRING, "pdsch_modulation"),
    ),
    "pusch": (
        *_COMMON,
        *_IDENTITY,
        _UL_CHANNEL,
        *_UL_WIDTH,
        _spacing("ul_scs_khz", "pusch_scs"),
        _CELL_TYPE,
        Column(
            "throughput_mbps",
            DOUBLE,
            _h("lte_net_pusch_throughput"),
            _h("5g_nr_net_pusch_throughput"),
        ),
        _both("mcs", DOUBLE, "mcs"),
        _both("avg_pusch_layers", DOUBLE, "avg_pusch_layers"),
        _both("pusch_rbs", DOUBLE, "pusch_rbs"),
        _both("modulation", STRING, "pusch_modulation"),
    ),
}

# Columns delivered in Kbps and stored in Mbps.
KILO_COLUMNS = ("throughput_mbps",)

CATEGORY_LABELS = {
    "radio": "Radio",
    "neighbor": "Neighbour",
    "pdsch": "PDSCH",
    "pusch": "PUSCH",
}

# (category, metric, label, unit)
METRIC_ROWS = (
    ("radio", "rsrp_dbm", "RSRP / SS-RSRP", "dBm"),
    ("radio", "rsrq_db", "RSRQ / SS-RSRQ", "dB"),
    ("radio", "rssi_dbm", "RSSI", "dBm"),
    ("radio", "sinr_db", "SINR / SS-SINR", "dB"),
    ("neighbor", "rsrp_dbm", "RSRP / SS-RSRP", "dBm"),
    ("neighbor", "rsrq_db", "RSRQ / SS-RSRQ", "dB"),
    ("neighbor", "rssi_dbm", "RSSI", "dBm"),
    ("neighbor", "sinr_db", "SS-SINR", "dB"),
    ("pdsch", "throughput_mbps", "Net PDSCH throughput", "Mbps"),
    ("pdsch", "mcs", "MCS", ""),
    ("pdsch", "avg_pdsch_layers", "Average PDSCH layers", ""),
    ("pdsch", "pdsch_rbs", "PDSCH RBs", ""),
    ("pdsch", "bler", "PDSCH BLER", ""),
    ("pusch", "throughput_mbps", "Net PUSCH throughput", "Mbps"),
    ("pusch", "mcs", "MCS", ""),
    ("pusch", "avg_pusch_layers", "Average PUSCH layers", ""),
    ("pusch", "pusch_rbs", "PUSCH RBs", ""),
)

POINT_COLUMNS = (
    "collection_name",
    "measured_at",
    "latitude",
    "longitude",
    "technology",
    "rat",
    "operator_name",
    "model",
    "band_number",
    "pci",
    "ssb_index",
    "metric_value",
)

DETAIL_COLUMNS = {
    "radio": (
        "dl_channel_number",
        "ul_channel_number",
        "dl_bandwidth_mhz",
        "ul_bandwidth_mhz",
        "dl_scs_khz",
        "cell_type",
    ),
    "neighbor": (
        "dl_channel_number",
        "ul_channel_number",
        "dl_scs_khz",
        "is_serving_beam",
    ),
    "pdsch": (
        "dl_channel_number",
        "dl_bandwidth_mhz",
        "dl_bandwidth_aggregated_mhz",
        "dl_scs_khz",
        "cell_type",
        "modulation",
    ),
    "pusch": (
        "ul_channel_number",
        "ul_bandwidth_mhz",
        "ul_bandwidth_aggregated_mhz",
        "ul_scs_khz",
        "cell_type",
        "modulation",
    ),
}

# Rows of these categories are kept only when every header holds one of the
# given texts, ignoring case and outer spaces.
ROW_FILTERS = {
    "pdsch": (
        ("test_name", ("Capacity", "Ookla(R)")),
        ("direction", ("Downlink",)),
        ("test_status", ("Completed",)),
    ),
    "pusch": (
        ("test_name", ("Capacity", "Ookla(R)")),
        ("direction", ("Uplink",)),
        ("test_status", ("Completed",)),
    ),
}

# Archived file stems that differ from their kind.
STEM_SYNONYMS = {
    "lte_radio_neig": "lte_radio_neighbor",
    "nr_radio_neig": "nr_radio_neighbor",
}

# Vendor file names, letters and digits only, with the archive stem they get.
VENDOR_STEMS = {
    "ltepdschpercarrier": "lte_pdsch",
    "ltepuschpercarrier": "lte_pusch",
    "lteradioneig": "lte_radio_neig",
    "lteradioconnected": "lte_radio",
    "nrpdschpercarrier": "nr_pdsch",
    "nrpuschpercarrier": "nr_pusch",
    "nrradiobeam": "nr_radio_neig",
    "nrradioconnected": "nr_radio",
}

# --- End of fixed values ---

CATEGORIES = tuple(COLUMNS)


def kind_of(category: str, technology: str) -> str:
    suffix = "radio_neighbor" if category == "neighbor" else category
    return f"{technology.lower()}_{suffix}"


# kind -> (category, technology)
KINDS = {kind_of(c, t): (c, t) for c in CATEGORIES for t in TECHNOLOGIES}

# archive stem -> kind
STEM_KINDS = {**{kind: kind for kind in KINDS}, **STEM_SYNONYMS}

METRICS: dict[str, dict[str, tuple[str, str]]] = {
    category: {m: (label, unit) for c, m, label, unit in METRIC_ROWS if c == category}
    for category in CATEGORIES
}

PARTITION_KEY = ("database_name", "collection_name", "measurement_type")

_SPARK_TYPES = {
    STRING: T.StringType(),
    LONG: T.LongType(),
    DOUBLE: T.DoubleType(),
    FLAG: T.BooleanType(),
    TIME: T.TimestampNTZType(),
}


def measurement_struct(kind: str) -> T.StructType:
    """Stored columns of one kind."""
    category, _ = KINDS[kind]
    return T.StructType(
        [T.StructField(c.name, _SPARK_TYPES[c.type], True) for c in COLUMNS[category]]
    )


def store_struct() -> T.StructType:
    """Columns of all kinds together, plus the kind, as the snapshot store is read."""
    fields: dict[str, T.DataType] = {}
    for columns in COLUMNS.values():
        for column in columns:
            fields.setdefault(column.name, _SPARK_TYPES[column.type])
    fields["measurement_type"] = T.StringType()
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PARTITIONS_STRUCT = T.StructType(
    [
        T.StructField("database_name", T.StringType(), False),
        T.StructField("collection_name", T.StringType(), False),
        T.StructField("measurement_type", T.StringType(), False),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("export_date", T.DateType(), False),
        T.StructField("exported_at", T.TimestampNTZType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("start_time", T.TimestampNTZType(), True),
        T.StructField("end_time", T.TimestampNTZType(), True),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("source_file_hash", T.StringType(), False),
        T.StructField("parquet_path", T.StringType(), False),
        T.StructField("processed_at", T.TimestampType(), True),
    ]
)

FILES_STRUCT = T.StructType(
    [
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("measurement_type", T.StringType(), False),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("export_date", T.DateType(), False),
        T.StructField("processed_at", T.TimestampType(), True),
    ]
)

SET_ASIDE_STRUCT = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("measurement_type", T.StringType(), True),
        T.StructField("file_hash", T.StringType(), True),
        T.StructField("problem", T.StringType(), False),
        T.StructField("length", T.LongType(), True),
        T.StructField("modified_at", T.TimestampType(), True),
        T.StructField("processed_at", T.TimestampType(), True),
    ]
)
