"""The category dimension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centsible.functions.text import comma_list, stable_id
from centsible.schemas import CATEGORY_SCHEMA

_INPUT_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("code", pa.string()),
        ("label", pa.string()),
        ("parent_id", pa.int64()),
        ("mcc_codes", pa.string()),
        ("keywords", pa.string()),
        ("path", pa.string()),
    ]
)

# Id, code, label, parent id, MCC list, keyword list.
SEED = [
    (1, "food_and_dining", "Food & Dining", None, None, "restaurant,cafe,coffee,food,eat,dining,bakery,pizza,sushi,burger"),
    (2, "groceries", "Groceries", 1, "5411,5422,5441,5451,5462,5499", "checkers,woolworths,pick n pay,spar,shoprite,food lover,grocery,supermarket,market"),
    (3, "restaurants", "Restaurants & Takeaways", 1, "5812,5813,5814", "restaurant,takeaway,kfc,mcdonalds,steers,nandos,pizza,spur,wimpy,fishaways"),
    (4, "transport", "Transport", None, None, "uber,bolt,taxi,transport,petrol,fuel"),
    (5, "fuel", "Fuel & Petrol", 4, "5541,5542,5172", "petrol,engen,bp,shell,caltex,sasol,total,fuel"),
    (6, "ride_hailing", "Ride Hailing", 4, "4121,4111", "uber,bolt,indriver,taxi,lyft,grab"),
    (7, "shopping", "Shopping", None, None, "shop,store,retail,buy"),
    (8, "clothing", "Clothing & Apparel", 7, "5651,5661,5699,5621,5631", "zara,h&m,mr price,cotton on,ackermans,woolworths fashion,clothing,apparel,shoes"),
    (9, "electronics", "Electronics", 7, "5732,5734,5045,5065", "apple,samsung,game,incredible connection,takealot,laptop,phone,electronics"),
    (10, "utilities", "Utilities", None, None, "electricity,water,rates,eskom,municipality"),
    (11, "telecoms", "Telecoms & Internet", 10, "4814,4812,4813,4899", "vodacom,mtn,telkom,cell c,rain,fibre,internet,airtime,data"),
    (12, "health", "Health & Medical", None, None, "doctor,clinic,hospital,pharmacy,medical"),
    (13, "pharmacy", "Pharmacy", 12, "5912,5047", "dischem,clicks,pharmacy,chemist,meds,medicine"),
    (14, "entertainment", "Entertainment", None, None, "netflix,spotify,cinema,sport,gym"),
    (15, "streaming", "Streaming & Subscriptions", 14, "7372,5961", "netflix,spotify,dstv,showmax,apple music,youtube premium,disney,subscription"),
    (16, "travel", "Travel", None, None, "flight,hotel,airbnb,travel,holiday"),
    (17, "accommodation", "Accommodation", 16, "7011,7012", "hotel,airbnb,booking.com,marriott,hilton,guesthouse,lodge,accommodation"),
    (18, "flights", "Flights", 16, "3000,3001,3002,4511", "kulula,flysafair,airlink,british airways,emirates,flight,airline"),
    (19, "uncategorised", "Uncategorised", None, None, None),
]


def _codes_from_root(row: tuple, by_id: dict[int, tuple]) -> list[str]:
    codes, seen = [row[1]], {row[0]}
    while (parent := by_id.get(row[3])) is not None:
        if parent[0] in seen:
            raise ValueError(f"the parents of category {codes[-1]!r} lead in a circle")
        row = parent
        seen.add(row[0])
        codes.append(row[1])
    return codes[::-1]


def load_categories(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Category rows ``(id, code, label, parent_id, mcc_codes, keywords)`` as the dimension.

    Comma lists become arrays with blank items dropped; the dotted path has the codes from the root down to the
    own code; the external id is derived from the code. Parents that lead in a circle are an error.
    """
    rows = SEED if rows is None else rows
    paths = [".".join(_codes_from_root(row, {row[0]: row for row in rows})) for row in rows]
    columns = [*map(list, zip(*rows)), paths] if rows else [[] for _ in _INPUT_SCHEMA]
    # from Arrow and without a join, so that Spark knows the size and can decide to broadcast it
    raw = spark.createDataFrame(pa.table(columns, schema=_INPUT_SCHEMA))
    return raw.select(
        "id",
        stable_id(F.col("code")).alias("external_id"),
        "code",
        "label",
        "path",
        "parent_id",
        comma_list(F.col("mcc_codes")).alias("mcc_codes"),
        comma_list(F.col("keywords")).alias("keywords"),
    )


def write_categories(categories: DataFrame, path: str) -> None:
    categories.coalesce(1).write.mode("overwrite").parquet(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORY_SCHEMA).parquet(path)
