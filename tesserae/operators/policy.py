"""Roles and the allow-list of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GUEST_ACTIONS = ("get_about", "get_license", "get_categories", "get_image", "get_public_settings", "get_site_name", "get_tags", "get_torrent", "get_torrent_info", "list_torrents")
USER_ACTIONS = (*GUEST_ACTIONS, "add_torrent", "get_canonical_info_hash", "change_password")
ADMIN_ACTIONS = (*USER_ACTIONS, "add_category", "delete_category", "get_settings", "get_secret_settings", "add_tag", "delete_tag", "delete_torrent", "ban_user")


def default_policy(spark: SparkSession) -> DataFrame:
    """(role, action) pairs that are allowed: 10 for guests, 13 for registered users, 21 for administrators."""
    rules = [(r, a) for r, actions in (("guest", GUEST_ACTIONS), ("registered", USER_ACTIONS), ("admin", ADMIN_ACTIONS)) for a in actions]
    return spark.createDataFrame(rules, "role string, action string")


def roles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests with the role of their user_id: guest where it is null or unknown."""
    known = users.select("user_id", "administrator")
    role = F.when(F.col("administrator"), "admin").when(F.col("administrator").isNotNull(), "registered").otherwise("guest")
    return requests.join(known, "user_id", "left").withColumn("role", role).drop("administrator")


def allowed(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Those requests(role, action, …) that the policy has."""
    return requests.join(policy, ["role", "action"], "left_semi")


def may_edit(owner: Column, user: Column, administrator: Column) -> Column:
    """Whether the user owns the entity or administers."""
    return F.coalesce(administrator | (owner == user), F.lit(False))
