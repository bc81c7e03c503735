"""Schema of the post table (reference input) and a required-column check.

The column list is the reference's; unsigned integer columns become Spark
``int`` (``short`` would lose 32,768-65,535), the timestamp has no zone.
The schema is a parameter of every reader: other layouts pass through as long
as the required columns are present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: the post table's columns in file order -----------------------
POST_COLUMNS = [
    "cand_id", "lastname_last", "firstname_last", "lastname_r_last", "firstname_r_last",
    "gender", "birthyear", "cand_id_duplicated_0", "election_id", "lastname", "firstname",
    "lastname_r", "firstname_r", "profession", "party", "incumbent", "elected", "cand_type",
    "list_no", "list_state", "district_no", "district_name", "district_state", "gles_id_13",
    "birthplace", "residence", "gles_id_17", "gles_id_21", "state", "invited", "participated",
    "mode", "ltw_id", "district_2_no", "district_2_name", "bezirk_name", "nomination_type",
    "party_long", "cand_id_duplicated_1", "twitter_id", "screen_name", "tweet_id",
    "twitter_id_duplicated_0", "conversation_id", "lang", "is_retweet", "is_quoted", "is_reply",
    "text", "likes", "image_url", "retweets", "quotes", "replies", "created_at",
]
# columns typed as unsigned 16-bit integers
UINT16_COLUMNS = ["cand_id", "birthyear", "cand_id_duplicated_0", "list_no", "district_no",
                  "gles_id_13", "gles_id_17", "gles_id_21", "district_2_no",
                  "cand_id_duplicated_1", "likes", "retweets", "quotes", "replies"]
# 0/1 flags typed as unsigned 8-bit integers
FLAG_COLUMNS = ["incumbent", "elected", "is_retweet", "is_quoted", "is_reply"]
TIMESTAMP_COLUMNS = ["created_at"]
# the columns any operator reads
REQUIRED = ["tweet_id", "text", "party", "created_at", "elected", "incumbent", "is_retweet",
            "is_quoted", "is_reply"]
# ---------------------------------------------------------------------------------


def _type(name: str) -> T.DataType:
    if name in UINT16_COLUMNS or name in FLAG_COLUMNS:
        return T.IntegerType()
    if name in TIMESTAMP_COLUMNS:
        return T.TimestampNTZType()
    return T.StringType()


POSTS = T.StructType([T.StructField(c, _type(c), True) for c in POST_COLUMNS])


def check_required(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
