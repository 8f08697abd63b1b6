"""The given tables seen as a fleet.

Every fleet table is a projection of one or two given tables. The scalar expressions are written once, in SQL both
engines understand, and used by the Spark views here and by the check SQL in ``plans.oracle``; nested columns
(labels, conditions, containers) are assembled on the Spark side only. ``MS(x)`` is epoch milliseconds and
``STR(x)`` text.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom import constants as C
from fleetloom.operators.rules import activity_rule_table, filter_rule_table
from fleetloom.plans.rule_sets import ACTIVITY_RULES, FILTER_RULES
from fleetloom.session import settled

# Fixed value: "now" of the registered queries, 2024-02-01T00:00:00Z.
NOW_MS = 1706745600000

NS_OF_ORDER = "'NATION_' || STR({k} % 26)"
ORDER_NS = NS_OF_ORDER.format(k="o_orderkey")

# view -> (given table, {column: expression}); expressions read the given table's columns only.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "workspaces": (
        "orders",
        {
            "namespace": ORDER_NS,
            "name": "'ws-' || STR(o_orderkey)",
            "uid": "'uid-' || STR(o_orderkey)",
            "generation": "1 + o_custkey % 3",
            "display_name": "case o_orderpriority when '5-LOW' then '  ' when '4-NOT SPECIFIED' then null "
            "else 'Desk ' || STR(o_custkey) end",
            "kind": "case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' "
            "then 'Retired#' || STR(o_custkey % 5) when o_custkey % 25 = 24 then 'Retired#9' else 'Brand#' || STR(o_custkey % 25 + 1) end",
            "image_id": "case when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' "
            "then 'img-gone-' || STR(o_custkey) else 'img-' || STR(o_custkey) end",
            "pod_id": "'pod-' || STR(o_custkey % 8)",
            "state": "case o_orderstatus when 'O' then 'Running' when 'F' then "
            "case o_orderpriority when '1-URGENT' then 'Error' when '2-HIGH' then 'Terminating' else 'Paused' end "
            "else case o_orderpriority when '1-URGENT' then '' when '2-HIGH' then 'Unknown' "
            "when '5-LOW' then 'Running' else 'Pending' end end",
            "state_message": "'status ' || o_orderstatus",
            "paused": "o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'",
            "last_running_ms": "case when o_orderstatus = 'P' and o_orderpriority <> '5-LOW' then 0 "
            f"when o_orderpriority = '5-LOW' then {NOW_MS} - cast(floor(o_totalprice) as bigint) * 3 "
            "else MS(o_orderdate) end",
            "pause_ms": "case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' "
            "then MS(o_orderdate) + 1000 else 0 end",
            "last_activity_ms": "case when o_totalprice < 20000 then 0 "
            f"when o_orderpriority = '5-LOW' then {NOW_MS} - cast(floor(o_totalprice) as bigint) * 40 "
            "else MS(o_orderdate) + cast(floor(o_totalprice) as bigint) * 10 end",
            "last_update_ms": "case when o_totalprice < 20000 then 0 "
            "else MS(o_orderdate) + cast(floor(o_totalprice) as bigint) * 10 + 5000 end",
            "eligible_after_ms": "case when o_orderpriority = '3-MEDIUM' then null when o_totalprice < 20000 then 0 "
            f"else {NOW_MS} - 600000 + cast(floor(o_totalprice) as bigint) * 5 end",
            "pod_name": "case when o_orderstatus = 'F' then '' else 'ws-' || STR(o_orderkey) || '-0' end",
            "pod_uid": "'pod-' || STR(o_orderkey)",
            "set_uid": "'set-' || STR(o_orderkey)",
            "created_ms": "MS(o_orderdate) - 86400000",
            "created_by": "case when o_orderpriority = '5-LOW' then null else 'user-' || STR(o_custkey) end",
            "updated_at": "case o_orderstatus when 'O' then '2024-01-0' || STR(1 + o_custkey % 9) || 'T10:20:30Z' "
            "when 'P' then 'yesterday' end",
            "updated_by": "case when o_orderstatus = 'O' then 'user-' || STR(o_custkey) end",
            "probe_start_ms": "case when o_orderstatus = 'P' then null when o_totalprice < 30000 then 0 "
            f"else {NOW_MS} - cast(floor(o_totalprice) as bigint) * 20 end",
            "probe_result": "case o_orderpriority when '1-URGENT' then 'Failure' when '2-HIGH' then 'Timeout' "
            "else 'Success' end",
        },
    ),
    "image_rows": (
        "part",
        {
            "kind": "'Brand#' || STR(p_partkey % 25 + 1)",
            "pos": "p_partkey",
            "id": "'img-' || STR(p_partkey)",
            "display_name": "p_name",
            "description": "case when p_size > 25 then 'Image ' || p_name end",
            "hidden": "case when p_size > 45 then null else p_size < 5 end",
            "type_label": "p_type",
            "size_label": "STR(p_size)",
            "redirect_to": "case when p_type = 'ECONOMY' then null "
            "when p_type = 'PROMO' and p_size < 10 then 'img-gone-' || STR(p_partkey) "
            "when p_type = 'SMALL' and p_size > 40 then 'img-' || STR(p_partkey) "
            "when p_type = 'LARGE' then 'img-' || STR(p_partkey + 25) "
            "when p_partkey < 25 * (1 + p_size % 3) then null "
            "else 'img-' || STR(p_partkey - 25 * (1 + p_size % 3)) end",
            "redirect_level": "case p_size % 4 when 0 then 'Warning' when 1 then 'Danger' when 2 then 'Info' "
            "else 'Loud' end",
            "redirect_text": "case when p_size > 10 then 'moved ' || p_name end",
            "size_num": "p_size",
            "part_type": "p_type",
        },
    ),
    "mounts": (
        "lineitem",
        {
            "namespace": NS_OF_ORDER.format(k="l_orderkey"),
            "workspace": "'ws-' || STR(l_orderkey)",
            "source": "case when l_linenumber = 1 then 'home' when l_returnflag = 'R' then 'secret' else 'data' end",
            "target": "case when l_linenumber > 1 and l_returnflag = 'R' "
            "then 'sec-' || STR(l_suppkey - l_suppkey % 26 + l_orderkey % 26) "
            "else 'pvc-' || STR(l_partkey - l_partkey % 26 + l_orderkey % 26) end",
            "mount_path": "case when l_linenumber = 1 then '/home/user' "
            "when l_discount > 0.085 and l_tax < 0.005 then '/' "
            "when l_discount > 0.085 and l_tax < 0.015 then '  ' "
            "when l_discount > 0.085 and l_tax < 0.025 then 'relative/path' "
            "when l_discount > 0.085 and l_tax < 0.035 then '//srv/data' "
            "when l_discount > 0.065 then ' /mnt/' || STR(l_partkey % 4) || '/ ' "
            "else '/mnt/' || STR(l_partkey % 4) end",
            "read_only": "case when l_tax < 0.015 then null else l_linestatus = 'O' end",
            "pos": "cast(l_linenumber as bigint)",
        },
    ),
    "pvcs": (
        "part",
        {
            "namespace": NS_OF_ORDER.format(k="p_partkey"),
            "name": "'pvc-' || STR(p_partkey)",
            "volume": "case when p_size > 40 then null else 'pv-' || STR(p_partkey) end",
            "storage_class": "case p_type when 'PROMO' then '' when 'ECONOMY' then 'sc-missing' "
            "else 'sc-' || STR(p_partkey % 10) end",
            "size": "STR(p_size) || 'Gi'",
            "can_mount_label": "case when p_size < 20 then 'true' when p_size < 30 then 'false' "
            "when p_size < 33 then 'True' when p_size < 45 then 'true' end",
            "can_update_label": "case when p_retailprice < 950 then 'true' when p_retailprice < 1000 then 'no' end",
            "mode_class": "case when p_size < 15 then 'rwo' when p_size < 30 then 'rwop' when p_size < 40 then 'rwx' "
            "else 'mixed' end",
        },
    ),
    "pvs": (
        "part",
        {
            "name": "case when p_type = 'LARGE' then 'pv-orphan-' || STR(p_partkey) else 'pv-' || STR(p_partkey) end",
            "uid": "'pvu-' || STR(p_partkey)",
            "reclaim": "case when p_size < 25 then 'Delete' else 'Retain' end",
            "mode": "'Filesystem'",
        },
    ),
    "storage_classes": (
        "supplier",
        {
            "name": "'sc-' || STR(s_suppkey)",
            "uid": "'scu-' || STR(s_suppkey)",
            "display_name": "case when s_acctbal < 0 then null else 'Class ' || s_name end",
            "can_use_label": "case when s_acctbal < 0 then 'false' when s_acctbal < 6000 then 'true' end",
        },
    ),
    "secret_meta": (
        "customer",
        {
            "namespace": NS_OF_ORDER.format(k="c_custkey"),
            "name": "'sec-' || STR(c_custkey)",
            "can_mount_label": "case when c_acctbal < 1000 then 'false' when c_acctbal < 8000 then 'true' end",
            "can_update_label": "case when c_mktsegment = 'BUILDING' then 'true' "
            "when c_mktsegment = 'MACHINERY' then 'false' end",
        },
    ),
    "sets": (
        "orders",
        {
            "namespace": ORDER_NS,
            "name": "'ws-' || STR(o_orderkey)",
            "uid": "'set-' || STR(o_orderkey)",
            "owner": "'ws-' || STR(o_orderkey)",
            "owner_uid": "case when o_totalprice > 150000 and o_orderstatus = 'F' then 'uid-old' "
            "else 'uid-' || STR(o_orderkey) end",
            "generation": "1 + o_custkey % 5",
            "observed_generation": "case when o_totalprice < 30000 then o_custkey % 5 else 1 + o_custkey % 5 end",
            "update_revision": "'rev-' || STR(o_custkey % 4)",
            "extra_set": "o_totalprice > 300000",
        },
    ),
    "pods": (
        "orders",
        {
            "namespace": ORDER_NS,
            "name": "case when o_orderstatus = 'F' and o_orderpriority <> '2-HIGH' "
            "or o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' "
            "then 'job-' || STR(o_orderkey) else 'ws-' || STR(o_orderkey) || '-0' end",
            "uid": "'pod-' || STR(o_orderkey)",
            "owner_uid": "case when o_totalprice > 180000 and o_orderstatus = 'P' then 'set-other' "
            "else 'set-' || STR(o_orderkey) end",
            "revision": "case when o_totalprice between 60000 and 70000 then 'rev-old' "
            "else 'rev-' || STR(o_custkey % 4) end",
            "node": "'node-' || STR(o_custkey % 50)",
            "phase": "case when o_orderstatus = 'O' then case when o_totalprice < 45000 then 'Pending' else 'Running' end "
            "when o_orderstatus = 'P' then case when o_totalprice < 100000 then 'Running' when o_totalprice < 120000 "
            "then 'Failed' else 'Unknown' end else 'Succeeded' end",
            "deleting": "o_orderstatus = 'F' and o_orderpriority = '2-HIGH'",
            "workspace_label": "case when o_orderstatus = 'F' and o_orderpriority <> '2-HIGH' then null "
            "else 'ws-' || STR(o_orderkey) end",
            "claim_a": "'pvc-' || STR(o_custkey - o_custkey % 26 + o_orderkey % 26)",
            "claim_b": "'pvc-' || STR(o_custkey - o_custkey % 26 + o_orderkey % 26 + 26)",
            "scheduled_status": "case when o_totalprice between 50000 and 56000 then 'False' else 'True' end",
            "scheduled_reason": "case when o_totalprice between 50000 and 52000 then 'Unschedulable' "
            "when o_totalprice between 52000 and 54000 then 'SchedulingGated' "
            "when o_totalprice between 54000 and 55000 then 'SchedulerError' else 'Other' end",
            "scheduled_message": "'node ' || STR(o_custkey % 50)",
            "ready_status": "case when o_orderstatus = 'O' and o_totalprice > 46000 then 'True' else 'False' end",
            "ready_message": "'containers ' || STR(o_custkey % 7)",
            "waiting_reason": "case when o_orderstatus = 'P' and o_totalprice < 75000 then 'CrashLoopBackOff' "
            "when o_orderstatus = 'P' and o_totalprice < 80000 then 'ImagePullBackOff' "
            "when o_orderstatus = 'O' and o_totalprice < 46000 then 'ContainerCreating' end",
            "waiting_message": "'back-off ' || STR(o_custkey % 9)",
            "has_previous": "o_custkey % 2 = 0",
            "sidecar": "case when o_orderpriority = '5-LOW' then 'proxy' else 'helper' end",
            "cpu_request": "case when o_orderpriority = '1-URGENT' then null else STR(100 + o_custkey % 10) || 'm' end",
            "cpu_limit": "STR(1 + o_custkey % 4)",
            "memory_request": "STR(128 + o_custkey % 64) || 'Mi'",
            "memory_limit": "case when o_orderpriority = '2-HIGH' then null else STR(1 + o_custkey % 8) || 'Gi' end",
        },
    ),
    "object_events": (
        "events",
        {
            "event_id": "event_id",
            "namespace": "case when value < 2 then 'NATION_' || STR((user_id + 1) % 26) "
            "else 'NATION_' || STR(user_id % 26) end",
            "involved_kind": "case event_type when 'signup' then 'StatefulSet' when 'purchase' then 'Node' "
            "else 'Pod' end",
            "involved_uid": "case when value < 1 then '' when event_type = 'signup' then 'set-' || STR(user_id) "
            "else 'pod-' || STR(user_id) end",
            "type": "case when event_type in ('error', 'signup', 'purchase') and value < 100 then 'Warning' "
            "else 'Normal' end",
            "reason": "'Reason-' || event_type",
            "message": "props",
            "last_ms": "MS(ts)",
            "change_op": "case event_type when 'click' then 'update' when 'view' then 'delete' "
            "else case when value > 60 then 'generic' else 'create' end end",
            "source_host": "'node-' || STR(user_id % 50)",
        },
    ),
    "probes": (
        "events",
        {
            "event_id": "event_id",
            "namespace": NS_OF_ORDER.format(k="user_id"),
            "workspace": "'ws-' || STR(user_id)",
            "start_ms": "MS(ts)",
            "end_ms": "MS(ts) + cast(floor(value * 10) as bigint)",
            "result": "case event_type when 'error' then 'Failure' when 'signup' then 'Timeout' else 'Success' end",
            "message": "'probe ' || event_type",
            "output": "case event_type when 'click' then '{\"has_activity\": true}' "
            "when 'view' then '{\"has_activity\": false}' when 'purchase' then "
            "case when value < 10 then '  ' when value < 30 then '{\"last_activity\": \"2024-01-0' || "
            "STR(1 + user_id % 9) || 'T08:00:00Z\"}' when value < 40 then 'not json' when value < 50 then '{}' "
            "when value < 60 then '{\"last_activity\": \"noon\"}' when value < 70 then '{\"has_activity\": \"yes\"}' "
            "else '{\"has_activity\": false, \"last_activity\": \"2024-01-01T00:00:00Z\"}' end else '' end",
        },
    ),
    "state_history": (
        "events",
        {
            "namespace": NS_OF_ORDER.format(k="user_id"),
            "workspace": "'ws-' || STR(user_id)",
            "ts_ms": "MS(ts)",
            "seq": "event_id",
            "state": "case event_type when 'click' then 'Running' when 'view' then 'Running' when 'error' then 'Error' "
            "when 'signup' then 'Pending' else 'Paused' end",
            "paused": "event_type = 'purchase' or event_type = 'signup' and value > 30",
        },
    ),
    "usage_samples": (
        "lineitem",
        {
            "namespace": NS_OF_ORDER.format(k="l_orderkey"),
            "pod": "'ws-' || STR(l_orderkey) || '-0'",
            "container": "case l_linenumber when 1 then 'main' when 2 then 'main' when 3 then 'proxy' else 'other' end",
            "ts_ms": "MS(l_shipdate)",
            "seq": "cast(l_linenumber as bigint)",
            "cpu": "case when l_tax < 0.015 then STR(cast(l_quantity as bigint) * 30000000) || 'n' "
            "when l_tax < 0.045 then STR(cast(l_quantity as bigint) * 10) || 'm' "
            "when l_tax < 0.055 then STR(cast(l_quantity as bigint)) || '.5' "
            "when l_tax < 0.065 then '' else STR(cast(l_quantity as bigint)) end",
            "memory": "case when l_discount < 0.015 then STR(cast(l_quantity as bigint)) || '.25Gi' "
            "when l_discount < 0.035 then STR(cast(l_quantity as bigint) * 1048576) "
            "when l_discount < 0.045 then 'Mi' when l_discount < 0.055 then STR(cast(l_quantity as bigint)) || 'k' "
            "when l_discount < 0.065 then 'lots' when l_discount < 0.075 then '.' "
            "else STR(cast(l_quantity as bigint)) || 'Mi' end",
        },
    ),
    "owned_objects": (
        "lineitem",
        {
            "flag": "l_returnflag",
            "namespace": "'NATION_' || STR(l_partkey % 26)",
            "owner": "'ws-' || STR(l_partkey)",
            "role": "'role-' || STR(l_suppkey % 7)",
            "name": "'obj-' || STR(l_orderkey) || '-' || STR(l_linenumber) || '-' || STR(l_suppkey) || '-' || "
            "STR(cast(round(l_extendedprice * 100) as bigint))",
            "subject": "'user-' || STR(l_linenumber)",
            "mode": "l_linestatus",
            "tier": "case when l_tax < 0.045 then '' else 'gold' end",
            "owner_uid": "case when l_discount < 0.055 then 'uid-' || STR(l_partkey) else 'uid-stale' end",
            "owner_kind": "case when l_tax > 0.075 then 'Deployment' else 'Workspace' end",
            "owner_api": "case when l_discount > 0.085 then 'fleet.example.org/v1alpha1' "
            "when l_tax > 0.075 then 'apps/v1' else 'fleet.example.org/v1beta1' end",
        },
    ),
    "helper_objects": (
        "lineitem",
        {
            "namespace": NS_OF_ORDER.format(k="l_orderkey"),
            "owner": "'ws-' || STR(l_orderkey)",
            "type": "case when l_linenumber = 1 or l_linenumber = 4 and l_suppkey % 10 = 0 then 'Service' "
            "when l_linenumber = 2 or l_linenumber >= 5 and l_suppkey % 10 = 1 then 'ServiceAccount' "
            "when l_linenumber = 3 or l_linenumber >= 5 and l_suppkey % 10 = 2 then 'VirtualService' else 'ConfigMap' end",
            "name": "'help-' || STR(l_orderkey) || '-' || STR(l_linenumber)",
        },
    ),
    "resource_entries": (
        "lineitem",
        {
            "object": "'res-' || STR(l_orderkey) || '-' || STR(l_linenumber) || '-' || STR(l_suppkey) || '-' || "
            "STR(cast(round(l_extendedprice * 100) as bigint))",
            "type": "case l_suppkey % 10 when 0 then 'cpu' when 1 then 'memory' when 2 then 'ephemeral-storage' "
            "when 3 then 'example.com/gpu' when 4 then 'hugepages-2Mi' when 5 then 'hugepages-x' when 6 then 'gpu' "
            "when 7 then 'Example.com/gpu' when 8 then 'kubernetes.io/disk' else '' end",
            "request": "case when l_tax < 0.015 then STR(cast(l_quantity as bigint)) || 'm' "
            "when l_tax < 0.025 then '-' || STR(cast(l_quantity as bigint)) "
            "when l_tax < 0.035 then STR(cast(l_quantity as bigint)) || '.5' "
            "when l_tax < 0.045 then STR(cast(l_quantity as bigint)) || 'e3' "
            "when l_tax < 0.055 then STR(cast(l_quantity as bigint)) || 'Mi' when l_tax < 0.065 then '' "
            "when l_tax < 0.075 then '1.2.3' else STR(cast(l_quantity as bigint)) end",
            "limit": "case when l_discount < 0.015 then STR(cast(l_quantity as bigint)) || 'Mi' "
            "when l_discount < 0.025 then STR(cast(l_quantity as bigint)) "
            "when l_discount < 0.035 then STR(cast(l_quantity as bigint)) || '.5' "
            "when l_discount < 0.045 then null when l_discount < 0.055 then STR(cast(l_quantity as bigint)) || 'Ki' "
            "when l_discount < 0.065 then '+' || STR(cast(l_quantity as bigint)) || '000m' "
            "when l_discount < 0.075 then STR(cast(l_quantity as bigint)) || 'kg' "
            "else STR(cast(l_quantity as bigint)) || 'Mi' end",
        },
    ),
    "change_requests": (
        "customer",
        {
            "request_id": "'chg-' || STR(c_custkey)",
            "op": "case c_mktsegment when 'BUILDING' then 'update_secret' when 'MACHINERY' then 'delete_secret' "
            "else 'delete_claim' end",
            "namespace": NS_OF_ORDER.format(k="c_custkey"),
            "name": "case when c_acctbal < -500 then 'gone-' || STR(c_custkey) "
            "when c_mktsegment in ('BUILDING', 'MACHINERY') then 'sec-' || STR(c_custkey) "
            "else 'pvc-' || STR(c_custkey) end",
        },
    ),
    "requests": (
        "orders",
        {
            "request_id": "'req-' || STR(o_orderkey)",
            "op": "case o_orderpriority when '1-URGENT' then 'create' when '2-HIGH' then 'pause' "
            "when '3-MEDIUM' then 'update' when '4-NOT SPECIFIED' then 'start' else 'update' end",
            "namespace": ORDER_NS,
            "name": "case when o_totalprice > 420000 then 'ws-none-' || STR(o_orderkey) "
            "else 'ws-' || STR(o_orderkey) end",
            "kind": "case when o_totalprice < 15000 then 'Retired#0' else 'Brand#' || STR(o_custkey % 25 + 1) end",
            "image_id": "case when o_totalprice < 60000 then 'img-' || STR(o_custkey) "
            "when o_totalprice < 90000 then 'img-' || STR(o_custkey + 25) else 'img-new-' || STR(o_custkey) end",
            "pod_id": "case when o_totalprice < 120000 then 'pod-' || STR(o_custkey % 8) "
            "else 'pod-' || STR((o_custkey + 1) % 8) end",
            "known_uid": "'uid-' || STR(o_orderkey)",
            "known_generation": "case when o_orderstatus = 'P' then o_custkey % 3 else 1 + o_custkey % 3 end",
        },
    ),
    "namespaces": (
        "nation",
        {
            "name": "n_name",
            "tier": "case n_nationkey % 3 when 0 then 'production' when 1 then 'staging' else 'dev' end",
            "region_key": "n_regionkey",
        },
    ),
}


def spark_sql_text(expression: str) -> str:
    expression = re.sub(r"MS\((\w+)\)", r"unix_millis(cast(\1 as timestamp))", expression)
    return expression.replace("STR(", "string(")


def _struct(**columns: Column) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def _entry(key: str, value: Column) -> Column:
    return _struct(key=F.lit(key), value=value)


def _labels_of(pairs: dict[str, Column]) -> Column:
    """Map of the pairs whose value is present."""
    entries = F.array(*[_entry(key, value) for key, value in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda entry: entry["value"].isNotNull()))


def _text(column: Column) -> Column:
    return column.cast("string")


class Fleet:
    """Lazy fleet tables over one folder of the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table, columns = VIEWS[name]
        return self.given(table).select(
            *[F.expr(spark_sql_text(expression)).alias(column) for column, expression in columns.items()]
        )

    @cached_property
    def namespaces(self) -> DataFrame:
        regions = self.given("region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region"))
        return (
            self.view("namespaces")
            .join(regions, "region_key", "left")
            .select("name", _labels_of({"tier": F.col("tier"), "region": F.col("region")}).alias("labels"))
        )

    @cached_property
    def workspaces(self) -> DataFrame:
        marks = {
            C.CREATED_BY: F.col("created_by"),
            C.UPDATED_AT: F.col("updated_at"),
            C.UPDATED_BY: F.col("updated_by"),
        }
        return self.view("workspaces").withColumn("annotations", _labels_of(marks))

    @cached_property
    def image_options(self) -> DataFrame:
        number = F.col("size_num")
        none = F.lit(None).cast("string")

        def port(key: str, n: Column, name: Column) -> Column:
            return _struct(id=F.lit(key), port=n.cast("int"), display_name=name)

        return self.view("image_rows").select(
            "kind",
            F.lit("image").alias("option_type"),
            "pos",
            "id",
            "display_name",
            "description",
            F.array(
                _entry("type", F.col("type_label")),
                _entry("size", F.col("size_label")),
                _entry("pythonVersion", F.concat(F.lit("3."), _text(number % 5))),
                _entry("type", F.when(number % 10 == 0, F.lit("CUSTOM")).otherwise(F.col("type_label"))),
            ).alias("labels"),
            "hidden",
            F.when(
                F.col("redirect_to").isNotNull(),
                _struct(to=F.col("redirect_to"), level=F.col("redirect_level"), text=F.col("redirect_text")),
            ).alias("redirect"),
            F.array(
                port("web", 8000 + number, F.when(number < 20, F.lit("Web UI"))),
                port("api", F.when(number % 9 == 0, 8000 + number).otherwise(9000 + number), none),
                port("debug", 7000 + number, F.lit("Debug")),
            ).alias("ports"),
            F.array(
                _struct(name=F.lit("LANG"), value=F.lit("C")),
                _struct(name=F.lit("SIZE"), value=F.col("size_label")),
                _struct(name=F.lit("TYPE"), value=F.col("type_label")),
            ).alias("env"),
            F.when(number > 30, F.lit("packer")).alias("scheduler"),
            F.when(number < 15, F.lit("Always")).alias("pull_policy"),
            F.lit(None).cast("struct<requests:map<string,string>,limits:map<string,string>>").alias("resources"),
            F.sha2(F.concat_ws("|", F.col("id"), F.col("type_label"), F.col("size_label")), 256).alias("spec_hash"),
        )

    @cached_property
    def pod_options(self) -> DataFrame:
        """One pod option per (kind, size class) seen in the part table."""
        k = F.col("k")
        rows = settled(
            self.given("part")
            .select(
                F.expr(spark_sql_text("'Brand#' || STR(p_partkey % 25 + 1)")).alias("kind"),
                (F.col("p_size") % 8).cast("bigint").alias("k"),
            )
            .distinct()
        )
        gpu = F.when(k == 5, F.lit("0")).when(k == 6, F.lit("2")).when(k == 7, F.lit("tesla"))
        target = F.when(k == 0, 1).when(k == 1, 2).when(k == 3, 4).when(k == 4, 3).when(k == 7, 9)
        labels = F.array(
            _entry("cpu", _text(k + 1)),
            _entry("memory", F.concat(_text((k + 1) * 2), F.lit("Gi"))),
            _entry("gpu", gpu),
        )
        return rows.select(
            "kind",
            F.lit("pod").alias("option_type"),
            k.alias("pos"),
            F.concat(F.lit("pod-"), _text(k)).alias("id"),
            F.concat(F.lit("Pod "), _text(k)).alias("display_name"),
            F.when(k < 6, F.concat(F.lit("Size class "), _text(k))).alias("description"),
            F.filter(labels, lambda entry: entry["value"].isNotNull()).alias("labels"),
            (k == 4).alias("hidden"),
            F.when(
                target.isNotNull(),
                _struct(
                    to=F.concat(F.lit("pod-"), _text(target)),
                    level=F.lit("Info"),
                    text=F.when(k < 4, F.concat(F.lit("use "), _text(target))),
                ),
            ).alias("redirect"),
            F.lit(None).cast("array<struct<id:string,port:int,display_name:string>>").alias("ports"),
            F.array(
                _struct(name=F.lit("SIZE"), value=F.concat(F.lit("pod-"), _text(k))),
                _struct(name=F.lit("POD"), value=_text(k)),
            ).alias("env"),
            F.when(k == 2, F.lit("gang")).alias("scheduler"),
            F.lit(None).cast("string").alias("pull_policy"),
            _struct(
                requests=_labels_of({"cpu": F.concat(_text((k + 1) * 250), F.lit("m"))}),
                limits=_labels_of({"cpu": F.when(k < 6, _text(k + 1)), "memory": F.concat(_text(k + 1), F.lit("Gi"))}),
            ).alias("resources"),
            F.sha2(F.concat_ws("|", F.col("kind"), _text(k)), 256).alias("spec_hash"),
        )

    @cached_property
    def options(self) -> DataFrame:
        return self.image_options.unionByName(self.pod_options)

    @cached_property
    def kinds(self) -> DataFrame:
        n = F.col("n")
        none = F.lit(None).cast("string")
        rows = settled(
            self.given("part")
            .groupBy((F.col("p_partkey") % 25 + 1).alias("n"))
            .agg(F.min("p_partkey").alias("first_part"), F.min(F.col("p_size") % 8).alias("first_pod"))
        )

        def asset(url: Column, name: Column, key: Column) -> Column:
            return _struct(
                url=url,
                namespace=F.when(url.isNull(), F.lit("assets")),
                name=F.when(url.isNull(), name),
                key=F.when(url.isNull(), key),
            )

        ports = F.array(
            _struct(
                id=F.lit("web"),
                protocol=F.lit("HTTP"),
                default_display_name=F.lit("Web"),
                remove_prefix=F.lit(None).cast("boolean"),
            ),
            _struct(
                id=F.lit("api"),
                protocol=F.lit("HTTP"),
                default_display_name=F.lit("API"),
                remove_prefix=F.lit(True),
            ),
            _struct(
                id=F.when(n <= 20, F.lit("debug")),
                protocol=F.when(n == 6, F.lit("TCP")).otherwise(F.lit("HTTP")),
                default_display_name=F.lit("Debugger"),
                remove_prefix=F.lit(False),
            ),
        )
        return rows.select(
            F.concat(F.lit("Brand#"), _text(n)).alias("name"),
            F.concat(F.lit("Kind "), _text(n)).alias("display_name"),
            F.when(n <= 20, F.concat(F.lit("Workbench "), _text(n))).alias("description"),
            F.when(n != 4, n.isin(3, 17)).alias("hidden"),
            F.when(n != 4, n.isin(5, 11)).alias("deprecated"),
            F.concat(F.lit("img-"), _text(F.col("first_part"))).alias("default_image"),
            F.when(n == 7, F.lit("pod-none"))
            .otherwise(F.concat(F.lit("pod-"), _text(F.col("first_pod"))))
            .alias("default_pod"),
            F.when(n == 2, F.lit("/mnt/1")).otherwise(F.lit("/home/user")).alias("home_path"),
            F.when(
                ~n.isin(9, 20),
                _struct(
                    min_interval_s=F.lit(300),
                    interval_s=F.when(n != 8, (3600 + n * 60).cast("int")),
                    timeout_s=F.lit(60),
                ),
            ).alias("probe"),
            F.filter(ports, lambda entry: entry["id"].isNotNull()).alias("ports"),
            F.array(F.lit("shm")).alias("extra_volumes"),
            F.array(
                _struct(name=F.lit("shm"), mount_path=F.lit("/dev/shm")),
                _struct(name=F.lit("shm"), mount_path=F.lit("/mnt/0")),
                _struct(name=F.lit("ghost"), mount_path=F.lit("/ghost")),
            ).alias("extra_mounts"),
            F.when(n % 5 == 0, F.lit("kind-scheduler")).alias("scheduler"),
            asset(
                F.when(n % 3 == 0, F.concat(F.lit("https://img.example.org/"), _text(n))),
                F.concat(F.lit("cfg-src"), _text(n % 20)),
                F.concat(F.lit("doc-"), _text(n)),
            ).alias("icon"),
            asset(
                none,
                F.when(n % 4 == 0, F.lit("cfg-none")).otherwise(F.concat(F.lit("cfg-src"), _text(n % 20))),
                F.when(n % 2 == 0, F.concat(F.lit("doc-"), _text(n % 20))).otherwise(F.lit("doc-none")),
            ).alias("logo"),
            _labels_of({"team": F.concat(F.lit("team-"), _text(n % 4)), "bad key": F.when(n == 6, F.lit("x"))}).alias(
                "labels"
            ),
            _labels_of({"cost": _text(n * 10), "team": F.lit("kind")}).alias("annotations"),
        )

    @cached_property
    def new_options(self) -> DataFrame:
        """The options of an edited kind: some removed, some with another spec or redirect, some added."""
        size = F.col("labels")[1]["value"].cast("int")
        images = self.image_options
        kept = images.filter((size > 3) | (F.col("labels")[0]["value"] != "STANDARD"))
        edited = kept.withColumn(
            "spec_hash", F.when(size % 7 == 0, F.concat("spec_hash", F.lit("x"))).otherwise(F.col("spec_hash"))
        ).withColumn("redirect", F.when(size % 11 != 0, F.col("redirect")))
        added = images.filter(size > 44).withColumn("id", F.concat("id", F.lit("-new")))
        return edited.unionByName(added).unionByName(self.pod_options)

    @cached_property
    def filter_rules(self) -> DataFrame:
        return filter_rule_table(self.kinds, FILTER_RULES)

    @cached_property
    def activity_rules(self) -> DataFrame:
        return activity_rule_table(self.kinds, ACTIVITY_RULES)

    @cached_property
    def part_rules(self) -> DataFrame:
        """A rule of its brand's kind for every part, so a kind has as many as it has parts.

        It asks for the part's type and for a region of the namespace: the part's (each seventh: any but that). Each
        eleventh names no region at all, which is not a valid condition.
        """
        regions = self.given("region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region"))
        parts = self.given("part").withColumn("region_key", F.col("p_partkey") % 5).join(regions, "region_key")
        key, effect = F.col("p_partkey"), F.col("p_size") % 4
        no_exprs = F.array().cast("array<struct<key:string,op:string,values:array<string>>>")
        op = F.when(key % 7 == 0, F.lit("NotIn")).otherwise(F.lit("In"))
        values = F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("region"))
        conditions = F.array(
            _struct(source=F.lit("image"), match_labels=F.create_map(F.lit("type"), F.col("p_type")), match_exprs=no_exprs),
            _struct(
                source=F.lit("namespace"),
                match_labels=F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                match_exprs=F.array(_struct(key=F.lit("region"), op=op, values=values)),
            ),
        )
        return parts.select(
            F.col("p_brand").alias("kind"),
            key.alias("rule_idx"),
            F.lit(C.SCOPE_IMAGE).alias("scope"),
            (effect == 2).alias("ui_hide"),
            (effect == 1).alias("api_hide"),
            (effect == 0).alias("deny"),
            F.col("p_name").alias("deny_message"),
            conditions.alias("conditions"),
        )

    @cached_property
    def mounts(self) -> DataFrame:
        return self.view("mounts")

    @cached_property
    def pvcs(self) -> DataFrame:
        mode = F.col("mode_class")
        modes = (
            F.when(mode == "rwo", F.array(F.lit("ReadWriteOnce")))
            .when(mode == "rwop", F.array(F.lit("ReadWriteOncePod")))
            .when(mode == "rwx", F.array(F.lit("ReadWriteMany")))
            .otherwise(F.array(F.lit("ReadWriteOnce"), F.lit("ReadOnlyMany")))
        )
        labels = _labels_of({C.CAN_MOUNT: F.col("can_mount_label"), C.CAN_UPDATE: F.col("can_update_label")})
        return self.view("pvcs").select(
            "namespace", "name", "volume", "storage_class", "size", modes.alias("access_modes"), labels.alias("labels")
        )

    @cached_property
    def pvs(self) -> DataFrame:
        return self.view("pvs")

    @cached_property
    def storage_classes(self) -> DataFrame:
        return self.view("storage_classes").select(
            "name",
            "uid",
            "display_name",
            _labels_of({C.CAN_USE: F.col("can_use_label")}).alias("labels"),
            _labels_of({"display-name": F.col("display_name")}).alias("annotations"),
        )

    @cached_property
    def secrets(self) -> DataFrame:
        """Secrets as stored, value included; operators read them through ``secret_metadata``."""
        labels = _labels_of({C.CAN_MOUNT: F.col("can_mount_label"), C.CAN_UPDATE: F.col("can_update_label")})
        rows = self.view("secret_meta").withColumn("labels", labels)
        return rows.select(
            "namespace",
            "name",
            "labels",
            _labels_of({"note": F.col("can_mount_label")}).alias("annotations"),
            F.sha2(F.col("name"), 256).cast("binary").alias("data"),
        )

    @cached_property
    def sets(self) -> DataFrame:
        """One set per workspace, two for the most expensive orders."""
        rows = self.view("sets")
        second = rows.filter("extra_set").withColumn("name", F.concat("name", F.lit("-b")))
        second = second.withColumn("uid", F.concat("uid", F.lit("-b")))
        return rows.unionByName(second).drop("extra_set")

    @cached_property
    def helper_objects(self) -> DataFrame:
        """Services, accounts and routes of workspaces, and other objects; some workspaces own two of a type."""
        return self.view("helper_objects")

    @cached_property
    def pods(self) -> DataFrame:
        none = F.lit(None).cast("string")

        def container(name: Column, init: bool, waiting: Column, previous: Column, owns: bool) -> Column:
            column = F.col
            return _struct(
                name=name,
                init=F.lit(init),
                waiting_reason=waiting,
                waiting_message=F.when(waiting.isNotNull(), column("waiting_message")),
                has_previous=previous,
                requests=_labels_of(
                    {"cpu": column("cpu_request") if owns else none, "memory": column("memory_request") if owns else none}
                ),
                limits=_labels_of(
                    {"cpu": column("cpu_limit") if owns else none, "memory": column("memory_limit") if owns else none}
                ),
            )

        return self.view("pods").select(
            "namespace",
            "name",
            "uid",
            "owner_uid",
            "revision",
            "node",
            "phase",
            "deleting",
            _labels_of({C.WORKSPACE_LABEL: F.col("workspace_label")}).alias("labels"),
            F.array("claim_a", "claim_a", "claim_b").alias("claims"),
            F.array(
                _struct(
                    type=F.lit("PodScheduled"),
                    status=F.col("scheduled_status"),
                    reason=F.col("scheduled_reason"),
                    message=F.col("scheduled_message"),
                ),
                _struct(type=F.lit("Ready"), status=F.col("ready_status"), reason=none, message=F.col("ready_message")),
            ).alias("conditions"),
            F.array(
                container(F.lit("main"), False, F.col("waiting_reason"), F.col("has_previous"), True),
                container(F.col("sidecar"), False, none, F.lit(False), False),
                container(F.lit("setup"), True, none, F.lit(True), False),
            ).alias("containers"),
        )

    @cached_property
    def object_events(self) -> DataFrame:
        return self.view("object_events").withColumn("last_ts", F.timestamp_millis("last_ms"))

    @cached_property
    def probes(self) -> DataFrame:
        return self.view("probes")

    @cached_property
    def state_history(self) -> DataFrame:
        return self.view("state_history")

    @cached_property
    def usage_samples(self) -> DataFrame:
        return self.view("usage_samples").withColumn("ts", F.timestamp_millis("ts_ms"))

    @cached_property
    def usage_reports(self) -> DataFrame:
        """Nested reports, one per sample, as the metrics source delivers them."""
        return self.usage_samples.select(
            "namespace",
            "pod",
            "ts",
            F.array(
                _struct(name=F.col("container"), cpu=F.col("cpu"), memory=F.col("memory")),
            ).alias("containers"),
        )

    @cached_property
    def log_text(self) -> DataFrame:
        """Log text as the runtime writes it: one ``<timestamp> <text>`` line per row."""
        base = 1704067200000
        ts = F.date_format(F.timestamp_millis(base + F.col("offset_ms")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        documents = self.given("documents").select(
            F.concat(F.lit("NATION_"), _text(F.col("doc_id") % 26)).alias("namespace"),
            F.concat(F.lit("ws-"), _text(F.col("doc_id"))).alias("workspace"),
            F.lit("main").alias("container"),
            F.posexplode(F.split("text", "\n")).alias("p", "line"),
        )
        turns = self.given("conversations").select(
            F.concat(F.lit("NATION_"), _text(F.col("conv_id") % 26)).alias("namespace"),
            F.concat(F.lit("ws-"), _text(F.col("conv_id"))).alias("workspace"),
            F.when(F.col("role") == "user", F.lit("main")).otherwise(F.lit("proxy")).alias("container"),
            (F.col("turn") * 60000).alias("offset_ms"),
            (F.col("turn") * 2 + 1).alias("seq"),
            F.col("text").alias("line"),
        )
        lines = documents.select(
            "namespace",
            "workspace",
            "container",
            (F.col("p") * 1000).cast("bigint").alias("offset_ms"),
            (F.col("p") * 2).cast("bigint").alias("seq"),
            "line",
        ).unionByName(turns)
        return lines.select(
            "namespace", "workspace", "container", "seq", F.concat(ts, F.lit(" "), F.col("line")).alias("value")
        )

    @cached_property
    def assets(self) -> DataFrame:
        """Stored images: text entries from documents, binary entries from pages; keys may clash."""

        def rows(df: DataFrame, name: Column, key: str, content: str, binary: bool) -> DataFrame:
            return df.select(
                F.lit("assets").alias("namespace"),
                F.concat(F.lit("cfg-"), name).alias("name"),
                F.concat(F.lit("doc-"), _text(F.col(key))).alias("key"),
                F.col(content).cast("binary").alias("content"),
                F.lit(binary).alias("is_binary"),
                _labels_of(
                    {C.IMAGE_SOURCE_LABEL: F.when(name.isin("src0", "src1", "src2", "src3"), F.lit("true"))}
                ).alias("labels"),
            )

        pages = self.given("pages")
        page_name = F.concat(F.lit("src"), _text(F.col("page_id") % 20))
        return rows(self.given("documents"), F.col("source"), "doc_id", "text", False).unionByName(
            rows(pages, page_name, "page_id", "html", True)
        )

    @cached_property
    def owned_objects(self) -> DataFrame:
        """Both sides: rows flagged N are desired only, R observed only, A on both sides."""
        sides = F.when(F.col("flag") == "N", F.array(F.lit("desired"))).when(
            F.col("flag") == "R", F.array(F.lit("observed"))
        ).otherwise(F.array(F.lit("desired"), F.lit("observed")))
        return (
            self.view("owned_objects")
            .withColumn("side", F.explode(sides))
            .select(
                "side",
                "namespace",
                "owner",
                "role",
                "name",
                F.array("subject").alias("subjects"),
                _labels_of({"mode": F.col("mode"), "tier": F.when(F.col("side") == "desired", F.col("tier"))}).alias(
                    "labels"
                ),
                _labels_of({"side": F.when(F.col("tier") == "gold", F.col("side"))}).alias("annotations"),
                F.array(F.lit("side")).alias("owned_keys"),
                "owner_uid",
                "owner_kind",
                "owner_api",
            )
        )

    @cached_property
    def requests(self) -> DataFrame:
        known = F.sha2(F.concat_ws(":", "known_uid", "name", _text(F.col("known_generation"))), 256)
        return self.view("requests").withColumn("revision", known).drop("known_uid", "known_generation")

    @cached_property
    def snapshot_levels(self) -> DataFrame:
        """Activity level per workspace and hourly snapshot; a workspace may be absent from a snapshot."""
        highest = F.max("value")
        level = F.when(highest > 60, F.lit("critical")).when(highest > 20, F.lit("warning")).otherwise(F.lit("none"))
        return (
            self.given("events")
            .groupBy(
                F.expr(spark_sql_text(NS_OF_ORDER.format(k="user_id"))).alias("namespace"),
                F.expr(spark_sql_text("'ws-' || STR(user_id)")).alias("workspace"),
                F.expr(spark_sql_text("MS(ts)") + " div 3600000").alias("snapshot_id"),
            )
            .agg(level.alias("level"))
        )
