"""Explicit schemas of everything read or written."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMMITS = _struct(
    repo=S, commit_sha=S, author_name=S, author_email=S, message=S, committed_at=TS
)
FILES = _struct(repo=S, file_id=L, current_path=S)
SYMBOLS = _struct(
    repo=S, symbol_id=L, file_id=L, commit_sha=S, kind=S, name=S, start_line=I, end_line=I
)

BLOBS = _struct(
    blob=S, parser=S, symbols=T.ArrayType(_struct(start_line=I, end_line=I, kind=S, name=S)), error=S
)
INDEXED = _struct(repo=S, commit_sha=S, number=L, tree=S)

_PERSON = _struct(name=S, email=S, date=S)
_REF = _struct(ref=S, sha=S)

COMMIT_DOCUMENT = _struct(
    sha=S, message=S, author=_PERSON, committer=_PERSON, url=S, code_diff=S
)
PR_DOCUMENT = _struct(
    number=L, title=S, body=S, state=S,
    created_at=S, updated_at=S, closed_at=S, merged_at=S,
    user=_struct(login=S, avatar_url=S), head=_REF, base=_REF,
    url=S, diff_url=S, patch_url=S, code_diff=S,
)

ENTITIES = _struct(
    repo=S, type=S, name=S, language=S, path=S, class_context=S, docstring=S, code=S,
    start_line=I, end_line=I, node_type=S,
)
VECTORS = T.StructType([
    T.StructField("collection", S),
    T.StructField("item_id", S),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
TEXT_VECTORS = T.StructType([
    T.StructField("model", S),
    T.StructField("text_hash", S),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
