"""One request in, one response out: what a web framework would wrap."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import PySparkException

from .engine import Context, Engine

# What clients are told of a request that is not run, in the order of the checks.
NOT_JSON_TYPE, NOT_JSON, NOT_OBJECT = "Unsupported Content-Type", "Invalid JSON", "Request body must be a JSON object"
FIELDS = {"query": (str, "Missing or invalid query"), "variables": (dict, "Invalid variables"), "operationName": (str, "Invalid operationName")}


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is not JSON")


def checked(content_type: str, body: bytes) -> tuple[int, dict | str]:
    """200 and the request, or 415 or 400 and what is wrong with it first."""
    if not content_type.startswith("application/json"):
        return 415, NOT_JSON_TYPE
    try:
        request = json.loads(body.decode(), parse_constant=_no_constant)
    except ValueError:
        return 400, NOT_JSON
    if not isinstance(request, dict):
        return 400, NOT_OBJECT
    for field, (kind, wrong) in FIELDS.items():
        value = request.get(field)
        if not isinstance(value, kind) and (value is not None or field == "query"):
            return 400, wrong
    return 200, request


def parts(engine: Engine, request: dict, context: Context) -> Iterator[str]:
    """The text of the data, entity by entity, so that the driver holds one partition of them at a time."""
    frames = engine.json(request["query"], request.get("variables"), context, request.get("operationName"))
    for k, (name, df) in enumerate(frames.items()):
        yield f"{',' if k else ''}{json.dumps(name)}:["
        for i, row in enumerate(df.toLocalIterator()):
            yield f"{',' if i else ''}{row[0]}"
        yield "]"


def respond(engine: Engine, content_type: str, body: bytes, context: Context = Context()) -> tuple[int, bytes]:
    """Status and JSON of an operation. An operation that fails, when read, planned or run, is a 200 without data.

    The whole response is one value of the driver, as a client wants a page; `Engine.execute` is for results that
    are to be stored.
    """
    status, request = checked(content_type, body)
    if status != 200:
        return status, json.dumps({"errors": [{"message": request}]}).encode()
    try:
        return 200, ('{"data":{' + "".join(parts(engine, request, context)) + "}}").encode()
    except PySparkException as e:
        wrong = e.getMessage() or str(e)
    except (ValueError, NotImplementedError) as e:
        wrong = str(e)
    return 200, json.dumps({"data": None, "errors": [{"message": wrong}]}).encode()
