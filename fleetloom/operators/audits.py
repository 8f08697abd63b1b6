"""Referential-integrity and syntax audits of whole tables, as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.constants import CAN_MOUNT, CAN_UPDATE, CAN_USE
from fleetloom.functions.labels import label_is_true, valid_label_key, valid_label_value
from fleetloom.functions.quantities import with_exact_quantity
from fleetloom.operators.report import coded_report, report, violation

# Name and path syntax.
DNS_LABEL = "[a-z0-9]([-a-z0-9]*[a-z0-9])?"
MOUNT_PATH_LENGTH = (2, 4096)
ANNOTATION_BYTES = 262144
PLAIN_RESOURCES = ("cpu", "memory", "ephemeral-storage")
HUGE_PAGES = "hugepages-"
RESERVED_DOMAIN = "kubernetes.io"
QUOTA_PREFIX = "requests."
QUALIFIED_NAME = "[a-zA-Z0-9]([-_.a-zA-Z0-9]*[a-zA-Z0-9])?"
SUBDOMAIN_LENGTH, QUALIFIED_LENGTH = 253, 63


def unknown_kinds(workspaces: DataFrame, kinds: DataFrame) -> DataFrame:
    """Workspaces whose kind does not exist."""
    bad = workspaces.join(kinds.select(F.col("name").alias("kind")), "kind", "left_anti")
    return bad.select(
        "namespace",
        "name",
        F.format_string('workspace kind "%s" not found', "kind").alias("message"),
    )


def _choices(workspaces: DataFrame) -> DataFrame:
    pair = F.array(
        F.struct(F.lit("image").alias("option_type"), F.col("image_id").alias("id")),
        F.struct(F.lit("pod").alias("option_type"), F.col("pod_id").alias("id")),
    )
    return workspaces.select("namespace", "name", "kind", F.explode(pair).alias("o")).select(
        "namespace", "name", "kind", "o.*"
    )


def unknown_options(
    workspaces: DataFrame, kinds: DataFrame, options: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """Selected options their (existing) kind does not define; with ``previous`` only changed choices are checked."""
    chosen = _choices(workspaces)
    if previous is not None:
        chosen = chosen.join(_choices(previous), ["namespace", "name", "kind", "option_type", "id"], "left_anti")
    return chosen.join(kinds.select(F.col("name").alias("kind")), "kind", "left_semi").join(
        options.select("kind", "option_type", "id"), ["kind", "option_type", "id"], "left_anti"
    )


def missing_defaults(kinds: DataFrame, options: DataFrame) -> DataFrame:
    pair = F.array(
        F.struct(F.lit("image").alias("option_type"), F.col("default_image").alias("id")),
        F.struct(F.lit("pod").alias("option_type"), F.col("default_pod").alias("id")),
    )
    defaults = kinds.select(F.col("name").alias("kind"), F.explode(pair).alias("o")).select("kind", "o.*")
    return defaults.join(options.select("kind", "option_type", "id"), ["kind", "option_type", "id"], "left_anti")


def dangling_redirects(options: DataFrame) -> DataFrame:
    """Options whose redirect target does not exist; all are reported."""
    edges = options.filter(F.col("redirect").isNotNull()).select(
        "kind", "option_type", F.col("id").alias("source"), F.col("redirect.to").alias("id")
    )
    missing = edges.join(options.select("kind", "option_type", "id"), ["kind", "option_type", "id"], "left_anti")
    return missing.withColumnRenamed("id", "target")


def port_violations(options: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per image port: number used before in the image, id unknown to the kind, protocol not supported.

    Port lists are part of one option, so the checks are array expressions on the option row.
    """
    ports = kinds.select(F.col("name").alias("kind"), F.col("ports").alias("kind_ports"))
    images = options.filter(F.col("option_type") == "image").select("kind", F.col("id").alias("image_id"), "ports")

    def checks(port: Column, i: Column) -> Column:
        used = F.exists(F.slice(F.col("ports"), 1, i), lambda other: other["port"] == port["port"])
        match = F.get(F.filter("kind_ports", lambda known: known["id"] == port["id"]), F.lit(0))
        number = port["port"].cast("string")
        return F.array(
            violation(used, port_id=port["id"], code="Duplicate", message=F.concat(F.lit("port "), number, F.lit(" is defined more than once"))),
            violation(match.isNull(), port_id=port["id"], code="Missing", message="missing from the ports of the kind"),
            violation(
                match["protocol"] != "HTTP",
                port_id=port["id"],
                code="Unsupported",
                message=F.concat(F.lit("unsupported protocol "), match["protocol"]),
            ),
        )

    found = F.array_compact(F.flatten(F.transform("ports", checks)))
    return (
        images.join(ports, "kind")
        .select("kind", "image_id", F.explode(found).alias("v"))
        .select("kind", "image_id", "v.*")
    )


def first_port_error(options: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, image_id, port_error): the first problem met while building a service from the image's ports."""
    ports = kinds.select(F.col("name").alias("kind"), F.col("ports").alias("kind_ports"))
    images = options.filter(F.col("option_type") == "image").select("kind", F.col("id").alias("image_id"), "ports")

    def error(port: Column, i: Column) -> Column:
        used = F.exists(F.slice(F.col("ports"), 1, i), lambda other: other["port"] == port["port"])
        match = F.get(F.filter("kind_ports", lambda known: known["id"] == port["id"]), F.lit(0))
        return (
            F.when(used, F.concat(F.lit("duplicate port number "), port["port"].cast("string"), F.lit(" in imageConfig")))
            .when(match.isNull(), F.concat(F.lit('port with id "'), port["id"], F.lit('" not found in workspaceKind')))
            .when(
                match["protocol"] != "HTTP",
                F.concat(
                    F.lit('unsupported protocol "'), match["protocol"], F.lit('" for port with id "'), port["id"], F.lit('"')
                ),
            )
        )

    first = F.get(F.array_compact(F.transform("ports", error)), F.lit(0))
    return images.join(ports, "kind").select("kind", "image_id", first.alias("port_error"))


def _reference_audit(uses: DataFrame, objects: DataFrame, keys: list[str], what: str, label: str) -> DataFrame:
    """Invalid when the object is missing, Forbidden when its label is not exactly "true"."""
    held = objects.select(*keys, label_is_true(F.col("labels"), label).alias("allowed"))
    name = F.col(keys[-1])
    missing = F.col("allowed").isNull()
    text = F.concat(F.lit(f'{what} "'), name, F.lit('" '))
    return report(
        uses.join(held, keys, "left"),
        uses.columns,
        [
            violation(missing, code="Invalid", message=F.concat(text, F.lit("not found"))),
            violation(
                ~missing & ~F.col("allowed"),
                code="Forbidden",
                message=F.concat(text, F.lit(f"is not labeled with {label}=true")),
            ),
        ],
    )


def claim_audit(mounts: DataFrame, pvcs: DataFrame, label: str = CAN_MOUNT) -> DataFrame:
    """Home and data claims must exist and be labelled mountable."""
    uses = mounts.filter(F.col("source") != "secret").select(
        "namespace", "workspace", "source", F.col("target").alias("name")
    )
    return _reference_audit(uses, pvcs, ["namespace", "name"], "claim", label)


def secret_audit(mounts: DataFrame, secrets: DataFrame, label: str = CAN_MOUNT) -> DataFrame:
    uses = mounts.filter(F.col("source") == "secret").select("namespace", "workspace", F.col("target").alias("name"))
    return _reference_audit(uses, secrets, ["namespace", "name"], "secret", label)


def storage_class_audit(pvcs: DataFrame, storage_classes: DataFrame, label: str = CAN_USE) -> DataFrame:
    uses = pvcs.select("namespace", F.col("name").alias("claim"), F.col("storage_class").alias("name"))
    return _reference_audit(uses, storage_classes, ["name"], "storage class", label)


def change_request_audit(requests: DataFrame, secrets: DataFrame, pvcs: DataFrame, label: str = CAN_UPDATE) -> DataFrame:
    """Requests to update or delete secrets and claims: the target must exist and be labelled updatable."""
    objects = secrets.select("namespace", "name", "labels", F.lit("secret").alias("target")).unionByName(
        pvcs.select("namespace", "name", "labels", F.lit("claim").alias("target"))
    )
    held = objects.select("namespace", "name", "target", label_is_true(F.col("labels"), label).alias("allowed"))
    asked = requests.withColumn(
        "target", F.when(F.col("op").endswith("secret"), F.lit("secret")).otherwise(F.lit("claim"))
    )
    outcome = (
        F.when(F.col("allowed").isNull(), F.lit("NotFound"))
        .when(~F.col("allowed"), F.lit("NotUpdatable"))
        .otherwise(F.lit("Accepted"))
    )
    return asked.join(held, ["namespace", "name", "target"], "left").select(
        "request_id", "op", "namespace", "name", outcome.alias("outcome")
    )


# --- resources -------------------------------------------------------------------------------------------------


def is_extended_resource(name: Column) -> Column:
    """A domain-prefixed resource name outside the reserved domain, short enough to be counted by a quota.

    A quota names the resource with its own prefix in front, so that prefix is not allowed in the name and its
    length is taken off the domain's.
    """
    domain = F.substring_index(name, "/", 1)
    local = F.substr(name, F.length(domain) + 2)
    fits = (F.length(domain) <= SUBDOMAIN_LENGTH - len(QUOTA_PREFIX)) & F.length(local).between(1, QUALIFIED_LENGTH)
    free = ~domain.endswith(RESERVED_DOMAIN) & ~domain.startswith(QUOTA_PREFIX)
    # the pattern runs on short text only
    spelled = F.when(fits & free, name.rlike(rf"^{DNS_LABEL}(\.{DNS_LABEL})*/{QUALIFIED_NAME}\z"))
    return F.coalesce(spelled, F.lit(False))


def is_huge_pages(name: Column) -> Column:
    return name.startswith(HUGE_PAGES)


def resource_class(name: Column) -> Column:
    return (
        F.when(name.isin(*PLAIN_RESOURCES), F.lit("plain"))
        .when(is_huge_pages(name), F.lit("hugepages"))
        .when(is_extended_resource(name), F.lit("extended"))
        .otherwise(F.lit("unsupported"))
    )


def resource_audit(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of (type, request, limit) rows as (keys, type, field, code). Entries without a type are ignored.

    Codes: ``unknown_type``; ``bad_page_size``; for each of request and limit ``malformed``, ``negative``,
    ``fractional`` (a counted resource), ``not_in_pages``, ``beyond`` (decimal(38,9) cannot hold the value, so it is
    reported instead of compared); for the pair ``differs_from_limit`` (counted resources and huge pages do not
    overcommit) and ``above_limit``. Findings are bits of one number, so only rows that have one are exploded.
    """
    rows = entries.filter(F.length("type") > 0).withColumn("class", resource_class(F.col("type")))
    sized, counted = F.col("class") == "hugepages", F.col("class") == "extended"
    rows = rows.withColumn("page", F.when(sized, F.substr("type", F.lit(len(HUGE_PAGES) + 1))))
    for name in ("request", "limit"):
        # an unknown type says nothing about its quantities
        rows = rows.withColumn(name, F.when((F.col("class") != "unsupported") & (F.length(name) > 0), F.col(name)))
    for name in ("request", "limit", "page"):
        rows = with_exact_quantity(rows, name, name)
    request, limit, page = F.col("request_value"), F.col("limit_value"), F.col("page_value")

    findings = [
        ("type", "unknown_type", F.col("class") == "unsupported"),
        ("type", "bad_page_size", sized & ~F.coalesce(page > 0, F.col("page_beyond"))),
        ("request", "differs_from_limit", (counted | sized) & (request != limit)),
        ("request", "above_limit", ~(counted | sized) & (request > limit)),
    ]
    for name, value in (("request", request), ("limit", limit)):
        beyond = F.col(f"{name}_beyond")
        findings += [
            (name, "malformed", F.col(name).isNotNull() & value.isNull() & ~beyond),
            (name, "negative", value < 0),
            (name, "fractional", counted & (value >= 0) & (value != F.floor(value))),
            (name, "not_in_pages", (page > 0) & (F.try_mod(value, page) != 0)),
            (name, "beyond", beyond),
        ]
    return coded_report(rows, [*keys, "type"], findings)


# --- names, paths and metadata ---------------------------------------------------------------------------------


def normalised_path(path: Column) -> Column:
    """Trimmed, without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), "/+$", "")


def mount_path_audit(mounts: DataFrame) -> DataFrame:
    """Syntax of each mount path, and paths used twice in one workspace, as rows with a ``code``.

    Codes: ``empty``, ``too_short``, ``too_long``, ``not_absolute`` (one slash, then a name) and ``in_use``. Uses are counted by a partial aggregate and joined back, so no workspace is gathered in one task.
    """
    rows = mounts.withColumn("path", normalised_path(F.col("mount_path")))
    keys = ["namespace", "workspace", "path"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("uses")).filter((F.col("uses") > 1) & (F.col("path") != ""))
    least, most = MOUNT_PATH_LENGTH
    trimmed = F.regexp_replace("mount_path", r"^\s+|\s+$", "")
    length = F.length(trimmed)
    sized = length.between(least, most)
    absolute = trimmed.startswith("/") & ~trimmed.startswith("//")
    return coded_report(
        rows.join(counts, keys, "left"),
        ["namespace", "workspace", "source", "target", "mount_path"],
        [
            (None, "empty", length == 0),
            (None, "too_short", (length > 0) & (length < least)),
            (None, "too_long", length > most),
            (None, "not_absolute", sized & ~absolute),
            (None, "in_use", F.col("uses") > 1),
        ],
    )


def valid_dns_label(name: Column) -> Column:
    return F.coalesce((F.length(name) <= 63) & name.rlike(rf"^{DNS_LABEL}\z"), F.lit(False))


def name_audit(df: DataFrame, object_type: str, keys: list[str], name: str = "name") -> DataFrame:
    bad = df.filter(~valid_dns_label(F.col(name)))
    return bad.select(*keys, F.lit(object_type).alias("object_type"), F.col(name).alias("bad_name"))


def metadata_audit(df: DataFrame, keys: list[str], labels: str | None = "labels", annotations: str | None = None) -> DataFrame:
    """Malformed label keys and values, malformed annotation keys, and annotations that are too large."""
    parts = []
    if labels is not None:
        parts.append(
            F.transform(
                F.map_entries(labels),
                lambda e: F.array(
                    violation(~valid_label_key(e["key"]), map=labels, key=e["key"], message="malformed label key"),
                    violation(~valid_label_value(e["value"]), map=labels, key=e["key"], message="malformed label value"),
                ),
            )
        )
    if annotations is not None:
        parts.append(
            F.transform(
                F.map_entries(annotations),
                lambda e: F.array(
                    violation(
                        ~valid_label_key(F.lower(e["key"])), map=annotations, key=e["key"], message="malformed annotation key"
                    )
                ),
            )
        )
        size = F.aggregate(
            F.map_entries(annotations),
            F.lit(0).cast("bigint"),
            lambda total, e: total + F.octet_length(e["key"]) + F.octet_length(e["value"]),
        )
        parts.append(
            F.array(
                F.array(violation(size > ANNOTATION_BYTES, map=annotations, key="", message="annotations are too large"))
            )
        )
    empty = F.array().cast("array<array<struct<map:string,key:string,message:string>>>")
    found = F.array_compact(F.flatten(F.concat(*[F.coalesce(part, empty) for part in parts])))
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")
