"""Category trees as parent-pointer tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.upsert import first_wins
from marketloom.session import cut

LEVELS = 8  # after which the lineage of a level is cut


def flattened(categories: DataFrame) -> DataFrame:
    """``(id, name, parent_id, depth, path)``: the tree in pre-order when sorted by ``path``.

    A level-wise join, as deep as the tree is; a row whose id is on its own path already ends there."""
    own = categories.select("id", "name", "parent_id")
    level = own.where("parent_id is null").select("id", "name", "parent_id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    out = level
    for depth in itertools.count(1):
        up = level.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
        level = own.join(up, F.col("parent_id") == F.col("_up")).select("id", "name", "parent_id", F.lit(depth).alias("depth"), "_path")
        level = level.where(~F.array_contains("_path", F.col("id"))).select("id", "name", "parent_id", "depth", F.concat("_path", F.array("id")).alias("path"))
        if depth % LEVELS == 0:
            level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def leaves(categories: DataFrame) -> DataFrame:
    """Categories without children."""
    parents = categories.select(F.col("parent_id").alias("_p")).where("_p is not null").distinct()
    return categories.join(parents, F.col("id") == F.col("_p"), "left_anti")


def all_ids(categories: DataFrame) -> DataFrame:
    """All ids of the tree as strings."""
    return flattened(categories).select(F.col("id").cast("string").alias("id"))


def node_count(categories: DataFrame) -> DataFrame:
    return flattened(categories).agg(F.count("*").alias("n_nodes"))


def crawl_targets(categories: DataFrame) -> DataFrame:
    """Leaves and top categories, one per slug, leaves first."""
    every = leaves(categories).withColumn("_o", F.lit(0)).unionByName(categories.where("level = 0").withColumn("_o", F.lit(1)))
    every = every.withColumn("_order", F.struct("_o", "id"))
    return first_wins(every, ["slug"], "_order").drop("_o", "_order")


# The categories of sources that list none themselves, by slug.
STATIC = {
    "lazada": {
        "dien-thoai-di-dong": "Mobiles",
        "shop-portable-speakers-&-boomboxes": "Portable Speakers",
        "shop-smartwatch-&-fitness-trackers": "Smartwatch",
        "micro-phones": "Microphones",
        "cap-dien-thoai": "Phone Cables",
        "bo-sac-co-day-cho-dien-thoai": "Wall Chargers",
        "shop-in-ear-headphones": "In-Ear Headphones",
        "camera-ip-ket-noi-internet": "IP Security Cameras",
        "den-trang-tri-chuyen-dung": "Fairy Lights",
        "op-lung-bao-da-dien-thoai": "Phone Cases",
        "duong-da-va-serum": "Serum & Essence",
        "may-tinh-bang": "Tablets",
        "laptop": "Laptops",
        "smart-tivi": "Televisions",
        "am-thanh": "Audio",
        "tu-lanh": "Refrigerators",
        "may-giat": "Washing Machines",
        "lo-vi-song": "Microwaves",
        "o-to-xe-may-thiet-bi-dinh-vi": "Automotive",
        "bach-hoa-online": "Grocery",
    },
    "dienmayxanh": {
        "may-lanh": "Máy lạnh",
        "may-giat": "Máy giặt",
        "tu-lanh": "Tủ lạnh",
        "tivi": "Tivi",
        "may-say-quan-ao": "Máy sấy quần áo",
        "may-nuoc-nong": "Máy nước nóng",
        "tu-dong": "Tủ đông",
        "may-rua-chen": "Máy rửa chén",
        "loa-ldp": "Loa, Dàn âm thanh",
        "micro-cac-loai": "Micro",
        "may-loc-nuoc": "Máy lọc nước",
        "noi-com-dien": "Nồi cơm điện",
        "noi-chien-khong-dau": "Nồi chiên không dầu",
        "may-loc-khong-khi": "Máy lọc không khí",
        "robot-hut-bui": "Robot hút bụi",
        "may-hut-bui": "Máy hút bụi",
        "bep-tu": "Bếp từ",
        "bep-ga": "Bếp ga",
        "quat": "Quạt",
        "dien-thoai": "Điện thoại",
        "laptop": "Laptop",
        "may-tinh-bang": "Tablet",
        "dong-ho-thong-minh": "Đồng hồ thông minh",
        "may-in": "Máy in",
        "may-say-toc": "Máy sấy tóc",
        "ghe-massage": "Ghế massage",
        "camera-giam-sat": "Camera giám sát",
        "tai-nghe": "Tai nghe",
        "sac-dtdd": "Sạc dự phòng",
    },
    "cellphones": {
        "mobile": "Điện thoại",
        "mobile/apple": "iPhone",
        "mobile/samsung": "Samsung",
        "tablet": "Tablet",
        "laptop": "Laptop",
        "laptop/mac": "MacBook",
        "thiet-bi-am-thanh": "Âm thanh",
        "do-choi-cong-nghe": "Đồng hồ",
        "do-gia-dung": "Gia dụng",
        "tivi": "Tivi",
    },
}


def static(spark: SparkSession, source: str) -> DataFrame:
    """The fixed categories of a source as a parent-pointer table; the slug is the id.  Other sources have none."""
    rows = [(slug, name, slug, 0, None) for slug, name in STATIC.get(source, {}).items()]
    return spark.createDataFrame(rows, "id string, name string, slug string, level int, parent_id string")


def with_fallback(nodes: DataFrame, source: str) -> DataFrame:
    """The categories that a source answered with, or its fixed ones if there are none."""
    own = from_nodes(nodes)
    columns = ["id", "name", "slug", "level", "parent_id"]
    own = own.select(F.col("id").cast("string"), "name", "slug", F.col("level").cast("int"), F.col("parent_id").cast("string"))
    return own if not own.isEmpty() else static(nodes.sparkSession, source).select(columns)


def from_nodes(nodes: DataFrame) -> DataFrame:
    """Nested ``{id, name, slug, level, children}`` rows as a parent-pointer table, as deep as their type is."""
    fields = ["id", "name", "slug", "level"]
    out = nodes.select(*fields, F.lit(None).cast(nodes.schema["id"].dataType).alias("parent_id"))
    level = nodes
    while "children" in level.columns:
        level = level.select(F.col("id").alias("parent_id"), F.explode("children").alias("c"))
        kept = [f for f in level.schema["c"].dataType.names]
        out = out.unionByName(level.select(*(F.col(f"c.{f}").alias(f) for f in fields), "parent_id"))
        level = level.select(*(F.col(f"c.{f}").alias(f) for f in kept))
    return out
