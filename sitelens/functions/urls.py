"""URL expressions. Malformed URLs give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.constants import NON_PAGE_SUFFIXES
from sitelens.functions.text import strip


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))


def authority(url: Column) -> Column:
    """Host with port, as written."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def normalise_base(domain: Column) -> Column:
    """scheme://authority of what a person types; https unless a scheme is given, null without a host."""
    typed = strip(domain)
    return origin(F.when(F.contains(typed, F.lit("//")), typed).otherwise(F.concat(F.lit("https://"), typed)))


def is_page(url: Column) -> Column:
    """Whether the path doesn't end like an image, a document or a feed."""
    ends = "|".join(s[1:] for s in NON_PAGE_SUFFIXES)
    return ~F.rlike(F.lower(F.regexp_extract(url, r"^[^?#]*", 0)), F.lit(rf"\.({ends})$"))


def status_in(reason: Column) -> Column:
    """The first whole number that stands alone in an abort reason."""
    return F.get(F.filter(F.split(reason, r"\s+"), lambda x: F.rlike(x, F.lit(r"^[0-9]+$"))), F.lit(0)).cast("int")


def abort_note(reason: Column) -> Column:
    """What an abort probably means."""
    refused = F.coalesce(status_in(reason).isin(401, 403), F.lit(False))
    return F.when(refused, "the site answers browsers but refuses this client, most likely by a firewall rule").otherwise("nothing was scored because the home page could not be read")
