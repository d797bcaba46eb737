"""Fixed schemas: no scan in this package infers types from the data."""

from __future__ import annotations

# Input tables, one Parquet file (or folder) each.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
}

# Catalogue files.
RAW_PRODUCT = (
    "country string, sku_id string, title string, category_1 string, category_2 string, "
    "category_3 string, description string, org_price float, product_type string"
)
CLEAN_PRODUCT = (
    "index long, title string, category_1 string, category_2 string, category_3 string, "
    "description string, concise int, clarity int"
)
PROCESSED_PRODUCT = (
    "index long, title string, new_title string, description string, new_des string, "
    "category_1 string, concise int, clarity int"
)

# Names of the product categories (fixed values, in the order the category number counts them).
CATEGORIES = [
    "Computers & Laptops",
    "Fashion",
    "TV, Audio / Video, Gaming & Wearables",
    "Mobiles & Tablets",
    "Health & Beauty",
    "Home Appliances",
    "Watches Sunglasses Jewellery",
    "Cameras",
    "Home & Living",
]
SEGMENT_A = ["Fashion", "Watches Sunglasses Jewellery"]

# Columns of the conciseness model (fixed values).
CONCISE_FEATURES = [
    "original_tokens",
    "des_same",
    "nsw_tokens",
    "sw_tokens",
    "regex_tokens",
    "tit_des_ratio",
    "repeat_tokens",
    "title_character_count",
    "clarity",
]
EARLY_FEATURES = [
    "original_tokens",
    "nsw_tokens",
    "sw_tokens",
    "regex_tokens",
    "tit_des_ratio",
    "repeat_tokens",
]

# Columns of the clarity model (fixed values).
CLARITY_FEATURES = [
    "count_num", "freq_num",
    "count_adj", "freq_adj",
    "count_noun", "freq_noun",
    "count_conj", "freq_conj",
    "count_color", "freq_color",
    "count_brand", "freq_brand",
    "count_words", "count_chars",
    "max_words_topic", "max_words_topic_freq", "topic_num",
    "title_cat_dup", "title_des_dup",
    "w2v_score", "tf_score", "sp_score",
]
COUNT_COLUMNS = [c for c in CLARITY_FEATURES if c.startswith("count_")]
SCORE_COLUMNS = ["w2v_score", "tf_score", "sp_score"]
