"""Files behind addresses: fetched host by host, with a cap that holds while they stream in."""

from __future__ import annotations

import hashlib
import http.client
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import MAX_FETCH

#: Seconds for a whole fetch, and bytes read at once.
TIMEOUT, BLOCK = 30.0, 64 << 10

_FETCHED = "id string, hash string, size long, changed boolean, content binary, error string"


class Refused(Exception):
    """Why an address gives no file."""


def _opener() -> urllib.request.OpenerDirector:
    """Opens http and https only; an address can't name a file of the executor."""
    opener = urllib.request.OpenerDirector()
    for handler in (urllib.request.ProxyHandler, urllib.request.HTTPHandler, urllib.request.HTTPSHandler, urllib.request.HTTPRedirectHandler, urllib.request.HTTPDefaultErrorHandler, urllib.request.HTTPErrorProcessor, urllib.request.UnknownHandler):
        opener.add_handler(handler())
    return opener


def download(url: str, most: int = MAX_FETCH, timeout: float = TIMEOUT) -> tuple[bytes, str]:
    """The bytes behind an address and their hash; ``Refused`` says why there are none.

    The size is checked as announced and again as bytes come in, so at most ``most`` bytes and a block are held.
    """
    until = time.monotonic() + timeout
    try:
        with _opener().open(url, timeout=timeout) as response:
            told = response.headers.get("Content-Length")
            if told and told.isdigit() and int(told) > most:
                raise Refused("too large")
            digest, held = hashlib.sha256(), bytearray()
            while block := response.read1(BLOCK):
                held += block
                if len(held) > most:
                    raise Refused("too large")
                if time.monotonic() > until:
                    raise Refused("too slow")
                digest.update(block)
            if told and told.isdigit() and len(held) < int(told):
                raise Refused("cut off")
            return bytes(held), f"sha256:{digest.hexdigest()}"
    except urllib.error.HTTPError as error:
        raise Refused(f"status {error.code}") from error
    except TimeoutError as error:
        raise Refused("too slow") from error
    except (OSError, http.client.HTTPException, ValueError) as error:
        slow = isinstance(getattr(error, "reason", None), TimeoutError)
        raise Refused("too slow" if slow else "unreachable") from error


def fetch(resources: DataFrame, most: int = MAX_FETCH, timeout: float = TIMEOUT, interval: float = 1.0) -> DataFrame:
    """(id, hash, size, changed, content, error) of resources (id, url, hash): what is behind their addresses.

    A host's addresses are one task's, which asks one after another, ``interval`` seconds apart at least;
    hosts are fetched side by side. ``changed`` is whether the hash is another than the known one. A row
    that gives no file has an ``error`` and no content; it doesn't fail the task. A row is handed on before
    the next one is fetched, so a task holds one file. A task that is run again asks again.
    """

    def run(batches):
        host, last = None, 0.0
        for batch in batches:
            for id, url, known, own in zip(batch["id"], batch["url"], batch["hash"], batch["host"], strict=True):
                row = {"id": id, "hash": None, "size": None, "changed": False, "content": None, "error": None}
                if own is None:
                    row["error"] = "no address"
                else:
                    if own == host:
                        time.sleep(max(0.0, last + interval - time.monotonic()))
                    host, last = own, time.monotonic()
                    try:
                        row["content"], row["hash"] = download(url, most, timeout)
                        row |= {"size": len(row["content"]), "changed": row["hash"] != known}
                    except Refused as error:
                        row["error"] = str(error)
                yield pd.DataFrame([row]).astype({"size": "Int64"})

    host = F.when(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))).isin("http", "https"), F.lower(F.try_parse_url("url", F.lit("HOST"))))
    asked = resources.select(F.col("id").cast("string").alias("id"), "url", F.col("hash").cast("string").alias("hash")).withColumn("host", host)
    # a row without a host goes anywhere
    dealt = asked.repartition(F.coalesce("host", F.col("id"))).sortWithinPartitions("host", "id")
    return dealt.mapInPandas(run, _FETCHED)
