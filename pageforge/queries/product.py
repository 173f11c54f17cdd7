"""Product scalar queries."""

from pyspark.sql import functions as F

from pageforge.functions import product as P
from pageforge.queries.base import derived, query

derived(
    "products",
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
      CASE p_partkey % 10 WHEN 0 THEN '$1,234.50' WHEN 1 THEN '1.234,50 €' WHEN 2 THEN concat('£', cast(p_size AS varchar(9)))
        WHEN 3 THEN 'chf 900.10' WHEN 4 THEN '900,1' WHEN 5 THEN '1,234' WHEN 6 THEN 'call us' WHEN 7 THEN '1.2.3'
        WHEN 8 THEN '1,234,567' END AS price_raw,
      CASE p_partkey % 8 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Sold out' WHEN 2 THEN 'Unavailable' WHEN 3 THEN 'Pre-order'
        WHEN 4 THEN 'few left' WHEN 5 THEN '?' WHEN 6 THEN '' END AS availability_raw,
      CASE p_partkey % 6 WHEN 0 THEN cast(p_size / 8 AS varchar(9)) WHEN 1 THEN '4.5 out of 5' WHEN 2 THEN '7' WHEN 3 THEN '-1'
        WHEN 4 THEN '1.0d' END AS rating_raw,
      CASE p_partkey % 5 WHEN 0 THEN concat(cast(p_size AS varchar(9)), '.9') WHEN 1 THEN 'many' WHEN 2 THEN '-3.7'
        WHEN 3 THEN ' 1e3 ' END AS reviews_raw,
      concat('https://shop.test/', CASE p_partkey % 4 WHEN 0 THEN 'phones' WHEN 1 THEN 'shoes' WHEN 2 THEN 'x' ELSE 'garden' END,
        '/', cast(p_partkey AS varchar(19))) AS product_url,
      CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('brand: ', p_brand, chr(10), ' size : ', cast(p_size AS varchar(9)), chr(10),
        'no separator', chr(10), 'size: a:b') END AS spec_text
    FROM {part}
    """,
    "part",
)

PRICE_SQL = """CASE p_partkey % 10 WHEN 0 THEN 1234.5 WHEN 1 THEN 1234.5 WHEN 2 THEN p_size WHEN 3 THEN 900.1 WHEN 4 THEN 900.1
  WHEN 5 THEN 1234 WHEN 8 THEN 1234567 END"""
# The same rule, worked on the text.
_KEPT = "regexp_replace(price_raw, '[^0-9.,]', '', 'g')"
_PRICE_RULE = """CASE WHEN contains(k, ',') AND contains(k, '.') THEN
    CASE WHEN length(k) - instr(reverse(k), ',') > length(k) - instr(reverse(k), '.') THEN replace(replace(k, '.', ''), ',', '.')
    ELSE replace(k, ',', '') END
  WHEN contains(k, ',') AND regexp_full_match(k, '[^,]*,[^,]{0,2}') THEN replace(k, ',', '.') ELSE replace(k, ',', '') END"""


@query("product_price", "products", f"SELECT p_partkey, try_cast({_PRICE_RULE} AS double) AS price FROM (SELECT *, {_KEPT} AS k FROM products)")
def product_price(rows):
    return rows.select("p_partkey", P.parse_price(F.col("price_raw")).alias("price"))


@query(
    "product_currency", "products",
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' ELSE 'USD' END AS currency FROM products""",
)
def product_currency(rows):
    return rows.select("p_partkey", P.currency_or_default(F.lit(None).cast("string"), F.col("price_raw")).alias("currency"))


AVAILABILITY_SQL = """CASE WHEN a IS NULL OR a = '' THEN NULL WHEN contains(a, 'in stock') OR contains(a, 'available') OR contains(a, 'ready') THEN 'in_stock'
  WHEN contains(a, 'out of stock') OR contains(a, 'sold out') THEN 'out_of_stock'
  WHEN contains(a, 'pre-order') OR contains(a, 'preorder') OR contains(a, 'coming soon') THEN 'pre_order'
  WHEN contains(a, 'limited') OR contains(a, 'few left') OR contains(a, 'last') THEN 'limited' ELSE 'unknown' END"""


@query(
    "product_availability", "products",
    f"SELECT p_partkey, {AVAILABILITY_SQL} AS availability FROM (SELECT *, lower(availability_raw) AS a FROM products)",
)
def product_availability(rows):
    return rows.select("p_partkey", P.availability(F.col("availability_raw")).alias("availability"))


RATING_SQL = """CASE p_partkey % 6 WHEN 0 THEN least(5.0, cast(p_size / 8 AS double)) WHEN 2 THEN 5.0 WHEN 3 THEN 0.0 END"""


@query("product_rating", "products", f"SELECT p_partkey, cast({RATING_SQL} AS double) AS rating FROM products")
def product_rating(rows):
    return rows.select("p_partkey", P.clamp_rating(F.col("rating_raw")).alias("rating"))


REVIEWS_SQL = "cast(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 2 THEN -3 WHEN 3 THEN 1000 END AS bigint)"


@query("product_reviews", "products", f"SELECT p_partkey, {REVIEWS_SQL} AS review_count FROM products")
def product_reviews(rows):
    return rows.select("p_partkey", P.parse_int_via_float(F.col("reviews_raw")).alias("review_count"))


@query(
    "product_specifications", "products",
    """
    SELECT p_partkey, 'brand' AS name, p_brand AS value FROM products WHERE p_partkey % 9 <> 0
    UNION ALL SELECT p_partkey, 'size', 'a:b' FROM products WHERE p_partkey % 9 <> 0
    """,
)
def product_specifications(rows):
    made = rows.select("p_partkey", P.specifications_from_text(F.col("spec_text")).alias("m"))
    return made.select("p_partkey", F.explode("m").alias("name", "value"))


@query(
    "product_specification_map", "products",
    """
    SELECT p_partkey, 'Brand' AS name, concat(p_brand, ' & co') AS value FROM products
    UNION ALL SELECT p_partkey, 'size', cast(p_size AS varchar) FROM products
    """,
)
def product_specification_map(rows):
    given = F.create_map(
        F.lit("Brand"), F.concat(F.lit(" "), "p_brand", F.lit("  &amp; co ")), F.lit("size"), F.col("p_size").cast("string")
    )
    made = rows.select("p_partkey", given.alias("g"))
    return made.select("p_partkey", F.explode(P.specifications_from_map(F.col("g"))).alias("name", "value"))


@query(
    "product_images", "products",
    """
    SELECT p_partkey, 0 AS n, concat('https://shop.test/i/', p_partkey, '.png') AS image FROM products
    UNION ALL SELECT p_partkey, 1, 'b.png' FROM products
    UNION ALL SELECT p_partkey, 2, 'http://cdn.test/c.png' FROM products
    """,
)
def product_images(rows):
    given = F.array(
        F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".png")), F.lit("b.png"),
        F.lit(None).cast("string"), F.lit("http://cdn.test/c.png"),
    )
    made = rows.select("p_partkey", P.image_list(F.col("product_url"), given).alias("i"))
    return made.select("p_partkey", F.posexplode("i").alias("n", "image"))
