"""File names and messages: what needs more than built-in columns is a small vectorised function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters a file name may keep.
KEPT = re.compile("[^\\w\\s\\-.ㄱ-ㅣ가-힣一-鿿぀-ヿ]")


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else KEPT.sub("_", unicodedata.normalize("NFC", n)))


def safe_file_name(c: Column) -> Column:
    """No separators, no parent folders, composed characters, 255 characters at most with the suffix kept."""
    flat = F.regexp_replace(F.replace(F.regexp_replace(c, "[/\\\\]", "_"), F.lit(".."), F.lit("_")), "^$", "")
    s = F.regexp_replace(F.regexp_replace(composed(flat), "_{2,}", "_"), "^[ _.]+|[ _.]+$", "")
    suffix = F.substring_index(s, ".", -1)
    short = F.when(F.contains(s, F.lit(".")), F.concat(F.substr(s, F.lit(1), F.greatest(F.lit(0), F.lit(254) - F.length(suffix))), F.lit("."), suffix)).otherwise(F.substring(s, 1, 255))
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed_document").when(F.length(s) > 255, short).otherwise(s)


def audit_action(method: Column, path: Column) -> Column:
    """What a request does, by its path first and its method else."""
    return (
        F.when(path.rlike("/auth/login$"), "LOGIN").when(path.rlike("/auth/logout$"), "LOGOUT").when(path.rlike("/search"), "SEARCH").when(path.rlike("/download|/export"), "DOWNLOAD")
        .when(method == "POST", "CREATE").when(method.isin("PUT", "PATCH"), "UPDATE").when(method == "DELETE", "DELETE").otherwise("READ")
    )


def resource_type(path: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(path, "^/api/(?:v\\d+/)?([a-z]+)", 1), F.lit("")), F.lit("unknown")))


def client_address(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address if it is one, else the peer's."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.when(is_address(first), first).otherwise(F.when(is_address(remote), remote))


def is_address(c: Column) -> Column:
    octet = "(25[0-5]|2[0-4]\\d|1?\\d?\\d)"
    return F.coalesce(c.rlike(f"^{octet}(\\.{octet}){{3}}$") | c.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]+$"), F.lit(False))
