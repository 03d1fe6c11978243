"""Explicit schemas for every input and output (no inference on the hot path)."""

from pyspark.sql import types as T

S = T.StringType()

GROUP = T.StructType([T.StructField("name", S)])
EXTRA = T.StructType([T.StructField("key", S), T.StructField("value", S)])
RESOURCE = T.StructType([
    T.StructField("name", S), T.StructField("url", S), T.StructField("format", S),
    T.StructField("description", S), T.StructField("size", T.LongType()),
])

PACKAGE = T.StructType([
    T.StructField("title", S),
    T.StructField("notes", S),
    T.StructField("url", S),
    T.StructField("metadata_created", S),
    T.StructField("groups", T.ArrayType(GROUP)),
    T.StructField("extras", T.ArrayType(EXTRA)),
    T.StructField("resources", T.ArrayType(RESOURCE)),
])

# One catalogue reply document: {success, error, result: {results: [package]}}
FEED_ENVELOPE = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("error", S),
    T.StructField("result", T.StructType([
        T.StructField("count", T.LongType()),
        T.StructField("results", T.ArrayType(PACKAGE)),
    ])),
])

COMPONENT = T.StructType([T.StructField("@id", S), T.StructField("componentId", S)])

# Object-store sidecar ("<qid>.fdo.json").
SIDECAR = T.StructType([
    T.StructField("@id", S),
    T.StructField("profile", T.StructType([
        T.StructField("name", S), T.StructField("description", S),
        T.StructField("url", S), T.StructField("softwareVersion", S),
    ])),
    T.StructField("kernel", T.StructType([
        T.StructField("modified", S),
        T.StructField("fdo:hasComponent", T.ArrayType(COMPONENT)),
    ])),
    T.StructField("provenance", T.StructType([
        T.StructField("prov:wasAttributedTo", S),
        T.StructField("prov:used", T.ArrayType(T.VariantType())),
    ])),
])

# Run metadata document: as the sidecar, but hasComponent may be one object
# or a list, and prov:used entries are strings or {"@id", "schema:query"}.
RUN_META = T.StructType([
    T.StructField("@id", S),
    T.StructField("kernel", T.StructType([
        T.StructField("modified", S),
        T.StructField("fdo:hasComponent", T.VariantType()),
    ])),
    T.StructField("provenance", T.StructType([
        T.StructField("prov:used", T.VariantType()),
    ])),
])

# Published (REST) projections: only these fields leave the catalogue jobs.
PUBLISHED = {
    "raw_datasets": ["path", "last_modified", "size_bytes"],
    "processed_datasets": ["qid", "name", "description", "source_url", "data_path",
                           "last_modified", "metadata_created", "doip_url"],
    "models": ["qid", "name", "docker_image", "docker_tag", "description", "doip_url", "git_repo"],
    "model_runs": ["run_id", "qid", "model_name", "docker_tag", "status", "run_timestamp",
                   "computation_time", "input_files", "output_files", "doip_url"],
}
