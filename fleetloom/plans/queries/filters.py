"""Predicates and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import labels as L
from fleetloom.functions import text as X
from fleetloom.operators import filters as B
from fleetloom.operators.joins import with_current_option
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

_SELECTOR = L.Selector(
    {"pythonVersion": "3.2"},
    (
        L.Requirement("type", "In", ("PROMO", "SMALL", "CUSTOM")),
        L.Requirement("size", "NotIn", ("2", "12", "22")),
        L.Requirement("gpu", "DoesNotExist"),
        L.Requirement("type", "Exists"),
    ),
)


@query(
    "selector_matches",
    """select kind, id, size_num % 5 = 2 and type in ('PROMO', 'SMALL', 'CUSTOM') and size not in ('2', '12', '22')
      as matches, type not in ('PROMO') as negative from image_ctx""",
)
def _selector_matches(t: Fleet) -> DataFrame:
    labels = L.labels_map(F.col("labels"))
    negative = L.Selector({}, (L.Requirement("type", "NotIn", ("PROMO",)), L.Requirement("zone", "NotIn", ("x",))))
    return t.image_options.select(
        "kind",
        "id",
        L.selector_matches(labels, _SELECTOR).alias("matches"),
        L.selector_matches(labels, negative).alias("negative"),
    )


@query(
    "selector_matches_ctx",
    """select w.namespace, w.name, n.name is not null as empty_selector, n.name is not null and n.tier <> 'dev' as not_dev,
      coalesce(n.tier, '') <> 'dev' as not_dev_lenient
    from workspaces w left join ns_labels n on n.name = w.namespace""",
)
def _selector_ctx(t: Fleet) -> DataFrame:
    labels = t.namespaces.select(F.col("name").alias("namespace"), "labels")
    not_dev = L.Selector({}, (L.Requirement("tier", "NotIn", ("dev",)),))
    joined = t.workspaces.select("namespace", "name").join(labels, "namespace", "left")
    return joined.select(
        "namespace",
        "name",
        L.selector_matches_ctx(F.col("labels"), L.Selector()).alias("empty_selector"),
        L.selector_matches_ctx(F.col("labels"), not_dev).alias("not_dev"),
        L.selector_matches(F.col("labels"), not_dev).alias("not_dev_lenient"),
    )


@query(
    "text_filter",
    """select doc_id, source, lang from documents where regexp_matches(text, '\\b(the|der|les?)\\b.*[.!?]', 'i')
      and regexp_matches(source, 'SRC1', 'i')""",
)
def _text_filter(t: Fleet) -> DataFrame:
    wanted = {"text": r"\b(the|der|les?)\b.*[.!?]", "source": "SRC1", "lang": ""}
    return X.text_filter(t.given("documents"), wanted).select("doc_id", "source", "lang")


@query("text_filter_literal", "select doc_id from documents where contains(text, '*')")
def _text_filter_literal(t: Fleet) -> DataFrame:
    # not a valid regex, so searched literally
    return X.text_filter(t.given("documents"), {"text": "*"}).select("doc_id")


@query(
    "multiselect",
    """select namespace, name from workspaces where lower(state) in ('running', 'paused')
      and lower(kind) in ('brand#3', 'brand#4', 'retired#1')""",
)
def _multiselect(t: Fleet) -> DataFrame:
    chosen = {"state": ["RUNNING", "paused"], "kind": ["brand#3", "BRAND#4", "Retired#1"], "name": []}
    return X.multiselect(t.workspaces, chosen).select("namespace", "name")


@query(
    "by_kind",
    "select namespace, name from workspaces where kind = 'Brand#8' and pod_id = 'pod-7'",
)
def _by_kind(t: Fleet) -> DataFrame:
    return B.by_kind(t.workspaces, "Brand#8", pod="pod-7").select("namespace", "name")


@query(
    "facet_filter",
    """select kind, id from image_rows where (type_label in ('PROMO', 'SMALL') or size_num % 10 = 0 and false)
      and size_num % 5 in (1, 2)""",
)
def _facet_filter(t: Fleet) -> DataFrame:
    selected = {"type": {"PROMO", "SMALL"}, "pythonVersion": {"3.1", "3.2"}, "size": set()}
    return X.facet_filter(t.image_options, selected).select("kind", "id")


@query(
    "visible",
    "select kind, option_type, id from options where not coalesce(hidden, false) and redirect_to is null",
)
def _visible(t: Fleet) -> DataFrame:
    return B.visible(t.options, show_hidden=False, show_redirected=False).select("kind", "option_type", "id")


@query(
    "running_idle_gpu",
    """select namespace, name, state = 'Running' as running, state <> 'Running' as idle, gpu_label is not null as gpu,
      state <> 'Running' and gpu_label is not null as idle_with_gpu from ws_options""",
)
def _running_idle_gpu(t: Fleet) -> DataFrame:
    joined = with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id", "state"),
        t.options.select("kind", "option_type", "id", "labels"),
    )
    gpu = B.has_gpu(F.col("pod_opt_labels"))
    return joined.select(
        "namespace",
        "name",
        B.is_running().alias("running"),
        B.is_idle().alias("idle"),
        gpu.alias("gpu"),
        (B.is_idle() & gpu).alias("idle_with_gpu"),
    )


@query(
    "relevant_event",
    """select event_id, namespace, involved_uid from object_events where type = 'Warning'
      and involved_kind in ('Pod', 'StatefulSet') and change_op in ('create', 'update')""",
)
def _relevant_event(t: Fleet) -> DataFrame:
    return B.relevant_event(t.object_events).select("event_id", "namespace", "involved_uid")


@query(
    "owned_by_workspace",
    """select side, namespace, owner, name from sided where owner_kind = 'Workspace'
      and owner_api like 'fleet.example.org/%'""",
)
def _owned_by_workspace(t: Fleet) -> DataFrame:
    return B.owned_by_workspace(t.owned_objects, "fleet.example.org").select("side", "namespace", "owner", "name")
