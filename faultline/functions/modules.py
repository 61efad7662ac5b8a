"""Key families that decide the Ansible change signals, as a table.

A key belongs to a family when its whole name is listed or when it starts with a prefix of the family.
Four of the five families of configuration-data modules are lists of names.  The network family (over a
thousand modules) is a rule: its modules carry the name of a platform in front.  Callers may add names,
also from a file with one name per line.

``family_table`` gives the families as rows ``(match, family)``; ``matches`` gives the values under which a
key finds its rows, so keys meet families in an equi-join however large the table is.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: module families (exact names) ---
DATABASE_MODULES = [
    "aerospike_migrations", "influxdb_database", "influxdb_query", "influxdb_retention_policy", "influxdb_user",
    "influxdb_write", "elasticsearch_plugin", "kibana_plugin", "redis", "riak", "mongodb_parameter",
    "mongodb_replicaset", "mongodb_shard", "mongodb_user", "mssql_db", "mysql_db", "mysql_replication",
    "mysql_user", "mysql_variables", "postgresql_db", "postgresql_ext", "postgresql_idx", "postgresql_info",
    "postgresql_lang", "postgresql_membership", "postgresql_owner", "postgresql_pg_hba", "postgresql_ping",
    "postgresql_privs", "postgresql_query", "postgresql_schema", "postgresql_set", "postgresql_slot",
    "postgresql_table", "postgresql_tablespace", "postgresql_user", "proxysql_backend_servers",
    "proxysql_global_variables", "proxysql_manage_config", "proxysql_mysql_users", "proxysql_query_rules",
    "proxysql_replication_hostgroups", "proxysql_scheduler", "vertica_configuration", "vertica_facts",
    "vertica_role", "vertica_schema", "vertica_user",
]
FILE_MODULES = [
    "acl", "archive", "assemble", "blockinfile", "copy", "fetch", "file", "find", "ini_file", "iso_extract",
    "lineinfile", "patch", "read_csv", "replace", "stat", "synchronize", "tempfile", "template", "unarchive",
    "xattr", "xml",
]
STORAGE_MODULES = [
    "emc_vnx_sg_member", "gluster_heal_facts", "gluster_peer", "gluster_volume", "ss_3par_cpg", "ibm_sa_domain",
    "ibm_sa_host", "ibm_sa_host_ports", "ibm_sa_pool", "ibm_sa_vol", "ibm_sa_vol_map", "infini_export",
    "infini_export_client", "infini_fs", "infini_host", "infini_pool", "infini_vol", "na_cdot_aggregate",
    "na_cdot_license", "na_cdot_lun", "na_cdot_qtree", "na_cdot_svm", "na_cdot_user", "na_cdot_user_role",
    "na_cdot_volume", "na_elementsw_access_group", "na_elementsw_account", "na_elementsw_admin_users",
    "na_elementsw_backup", "na_elementsw_check_connections", "na_elementsw_cluster", "na_elementsw_cluster_config",
    "na_elementsw_cluster_pair", "na_elementsw_cluster_snmp", "na_elementsw_drive", "na_elementsw_initiators",
    "na_elementsw_ldap", "na_elementsw_network_interfaces", "na_elementsw_node", "na_elementsw_snapshot",
    "na_elementsw_snapshot_restore", "na_elementsw_snapshot_schedule", "na_elementsw_vlan", "na_elementsw_volume",
    "na_elementsw_volume_clone", "na_elementsw_volume_pair", "na_ontap_aggregate", "na_ontap_autosupport",
    "na_ontap_broadcast_domain", "na_ontap_broadcast_domain_ports", "na_ontap_cg_snapshot", "na_ontap_cifs",
    "na_ontap_cifs_acl", "na_ontap_cifs_server", "na_ontap_cluster", "na_ontap_cluster_ha", "na_ontap_cluster_peer",
    "na_ontap_command", "na_ontap_disks", "na_ontap_dns", "na_ontap_export_policy", "na_ontap_export_policy_rule",
    "na_ontap_fcp", "na_ontap_firewall_policy", "na_ontap_flexcache", "na_ontap_gather_facts", "na_ontap_igroup",
    "na_ontap_igroup_initiator", "na_ontap_interface", "na_ontap_iscsi", "na_ontap_job_schedule",
    "na_ontap_license", "na_ontap_lun", "na_ontap_lun_copy", "na_ontap_lun_map", "na_ontap_motd",
    "na_ontap_net_ifgrp", "na_ontap_net_port", "na_ontap_net_routes", "na_ontap_net_subnet", "na_ontap_net_vlan",
    "na_ontap_nfs", "na_ontap_node", "na_ontap_ntp", "na_ontap_nvme", "na_ontap_nvme_namespace",
    "na_ontap_nvme_subsystem", "na_ontap_portset", "na_ontap_qos_policy_group", "na_ontap_qtree", "na_ontap_quotas",
    "na_ontap_security_key_manager", "na_ontap_service_processor_network", "na_ontap_snapmirror",
    "na_ontap_snapshot", "na_ontap_snapshot_policy", "na_ontap_snmp", "na_ontap_software_update", "na_ontap_svm",
    "na_ontap_svm_options", "na_ontap_ucadapter", "na_ontap_unix_group", "na_ontap_unix_user", "na_ontap_user",
    "na_ontap_user_role", "na_ontap_volume", "na_ontap_volume_clone", "na_ontap_vscan_on_access_policy",
    "na_ontap_vscan_on_demand_task", "na_ontap_vscan_scanner_pool", "na_ontap_vserver_peer", "netapp_e_alerts",
    "netapp_e_amg", "netapp_e_amg_role", "netapp_e_amg_sync", "netapp_e_asup", "netapp_e_auditlog", "netapp_e_auth",
    "netapp_e_facts", "netapp_e_flashcache", "netapp_e_global", "netapp_e_host", "netapp_e_hostgroup",
    "netapp_e_iscsi_interface", "netapp_e_iscsi_target", "netapp_e_ldap", "netapp_e_lun_mapping",
    "netapp_e_mgmt_interface", "netapp_e_snapshot_group", "netapp_e_snapshot_images", "netapp_e_snapshot_volume",
    "netapp_e_storage_system", "netapp_e_storagepool", "netapp_e_syslog", "netapp_e_volume", "netapp_e_volume_copy",
    "sf_account_manager", "sf_check_connections", "sf_snapshot_schedule_manager", "sf_volume_access_group_manager",
    "sf_volume_manager", "purefa_dns", "purefa_ds", "purefa_dsrole", "purefa_facts", "purefa_hg", "purefa_host",
    "purefa_ntp", "purefa_offload", "purefa_pg", "purefa_pgsnap", "purefa_ra", "purefa_snap", "purefa_user",
    "purefa_volume", "purefb_bucket", "purefb_ds", "purefb_dsrole", "purefb_facts", "purefb_fs", "purefb_network",
    "purefb_s3acc", "purefb_s3user", "purefb_snap", "purefb_subnet", "vexata_volume", "zfs", "zfs_delegate_admin",
    "zfs_facts", "zpool_facts",
]
IDENTITY_MODULES = [
    "onepassword_info", "cyberark_authentication", "cyberark_user", "ipa_config", "ipa_dnsrecord", "ipa_dnszone",
    "ipa_group", "ipa_hbacrule", "ipa_host", "ipa_hostgroup", "ipa_role", "ipa_service", "ipa_subca", "ipa_sudocmd",
    "ipa_sudocmdgroup", "ipa_sudorule", "ipa_user", "ipa_vault", "keycloak_client", "keycloak_clienttemplate",
    "keycloak_group", "opendj_backendprop",
]
# --- fixed values: platforms whose modules make up the network family, and its modules without one ---
NETWORK_PLATFORMS = [
    "a10", "aci", "aireos", "aos", "aruba", "asa", "avi", "bcf", "bigip", "bigiq", "bigmon", "ce", "checkpoint", "cli",
    "cnos", "cv", "dellos10", "dellos6", "dellos9", "dladm", "edgeos", "edgeswitch", "enos", "eos", "exos", "fmgr",
    "fortios", "frr", "ftd", "iap", "ig", "ios", "iosxr", "ipadm", "ironware", "junos", "meraki", "mso", "net", "netact",
    "netconf", "netscaler", "nos", "nso", "nuage", "nxos", "onyx", "openvswitch", "opx", "ordnance", "panos", "pn",
    "restconf", "routeros", "skydive", "slxos", "sros", "vdirect", "voss", "vyos",
]
NETWORK_MODULES = ["flowadm", "nclu"]
# --- fixed values: keys that include other tasks/roles/playbooks, and the service key ---
INCLUDE_KEYS = ["include", "include_role", "include_tasks", "include_vars", "import_playbook", "import_tasks",
                "import_role"]
SERVICE_KEYS = ["service"]


def load_module_names(path: str | Path) -> list[str]:
    """One module name per line (blank lines and ``#`` comments ignored)."""
    out = []
    for line in Path(path).read_text().splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            out.append(line)
    return out


def family_table(spark: SparkSession, extra: list[str] | DataFrame | None = None) -> DataFrame:
    """``(match, family)``: ``=name`` for whole names, ``^prefix_`` for prefixes; families ``data``, ``include``,
    ``service``.  ``extra`` adds names to ``data``: a list, or a table with a column ``module``."""
    exact = {"data": DATABASE_MODULES + FILE_MODULES + STORAGE_MODULES + IDENTITY_MODULES + NETWORK_MODULES,
             "include": INCLUDE_KEYS, "service": SERVICE_KEYS}
    rows = [("=" + name, family) for family, names in exact.items() for name in names]
    rows += [(f"^{platform}_", "data") for platform in NETWORK_PLATFORMS]
    table = spark.createDataFrame(rows, "match string, family string")
    if extra is not None and not isinstance(extra, DataFrame):
        extra = spark.createDataFrame([(name,) for name in extra], "module string")
    if extra is not None:
        table = table.union(extra.select(F.concat(F.lit("="), "module"), F.lit("data")))
    return table.distinct()


def matches(key: Column) -> Column:
    """The values of ``match`` that a key satisfies: its whole name and what it has up to the first underscore."""
    return F.array_compact(F.array(F.concat(F.lit("="), key), F.when(
        F.instr(key, "_") > 1, F.concat(F.lit("^"), F.substring_index(key, "_", 1), F.lit("_")))))


def sql_in_list(names: list[str]) -> str:
    """``'a', 'b', ...`` for an ``IN (...)`` test (Catalyst turns long lists into a hash set)."""
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)
