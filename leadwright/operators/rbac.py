"""Users, roles, permissions, sessions and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The permissions, and what each built-in role may do.
PERMISSIONS = (
    "users.manage", "roles.manage", "audit.view", "settings.manage", "domains.view", "domains.import", "crawl.run", "crawl.cancel_all", "jobs.view_all", "leads.view",
    "leads.edit", "leads.export", "leads.import", "campaigns.manage", "campaigns.dispatch", "campaigns.view_all", "templates.manage", "credentials.manage", "blacklist.manage",
)
ROLE_DEFAULTS = {
    "Admin": PERMISSIONS,
    "Operator": (
        "domains.view", "domains.import", "crawl.run", "leads.view", "leads.edit", "leads.export", "leads.import", "campaigns.manage", "campaigns.dispatch", "templates.manage",
        "credentials.manage", "blacklist.manage",
    ),
    "Viewer": ("domains.view", "leads.view"),
}


def permission_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PERMISSIONS], "key string")


def role_table(spark: SparkSession) -> DataFrame:
    """(role, permission_key) of the built-in roles."""
    return spark.createDataFrame([(r, p) for r, ps in ROLE_DEFAULTS.items() for p in ps], "role string, permission_key string")


def seeded(existing: DataFrame, defaults: DataFrame, key: list[str]) -> DataFrame:
    """A table with the default rows it lacks."""
    return existing.unionByName(defaults.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def effective_permissions(users: DataFrame, role_permissions: DataFrame, overrides: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, permission_key): a user's role's permissions and grants, without denials; an administrator has all.

    users: (id, role_id, is_admin); overrides: (user_id, permission_key, effect grant or deny).
    """
    plain = users.where(~F.coalesce("is_admin", F.lit(False))).select(F.col("id").alias("user_id"), "role_id")
    by_role = plain.join(role_permissions, "role_id").select("user_id", "permission_key")
    granted = overrides.where("effect = 'grant'").join(plain.select("user_id"), "user_id", "left_semi").select("user_id", "permission_key")
    denied = overrides.where("effect = 'deny'").select("user_id", "permission_key")
    admins = users.where("is_admin").select(F.col("id").alias("user_id")).join(permissions.select(F.col("key").alias("permission_key")), F.lit(True))
    return by_role.union(granted).distinct().join(denied, ["user_id", "permission_key"], "left_anti").union(admins)


def allowed(permission: str, held: Column, is_admin: Column) -> Column:
    return F.coalesce(is_admin, F.lit(False)) | F.array_contains(held, permission)


def owner_or(owner: Column, me: int, allow: Column) -> Column:
    """Whether a row is mine, or I may see those of others."""
    return owner.eqNullSafe(F.lit(me)) | allow


def unknown_permissions(keys: Column) -> Column:
    return F.array_except(keys, F.array(*map(F.lit, PERMISSIONS)))


def roles_with_permissions(roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Roles with their sorted permissions."""
    held = role_permissions.groupBy(F.col("role_id").alias("id")).agg(F.sort_array(F.collect_set("permission_key")).alias("permissions"))
    return roles.join(held, "id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def users_with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    return users.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name")), "role_id", "left")


def active_admins(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("is_admin") & F.col("is_active")).alias("active_admins"))


def admin_kept(users: DataFrame) -> DataFrame:
    """users (id) with kept: whether an active administrator is left without this user."""
    left = active_admins(users).first()["active_admins"]
    return users.select("id", (F.lit(left) - F.coalesce(F.col("is_admin") & F.col("is_active"), F.lit(False)).cast("int") > 0).alias("kept"))


def override_set(overrides: DataFrame, user_id: int, key: str, effect: str | None) -> DataFrame:
    """A user's override of a permission, or none."""
    rest = overrides.where(~((F.col("user_id") == user_id) & (F.col("permission_key") == key)))
    if effect is None:
        return rest
    return rest.unionByName(overrides.sparkSession.createDataFrame([(user_id, key, effect)], "user_id long, permission_key string, effect string"))


def role_removed(roles: DataFrame, users: DataFrame, role_id: int) -> DataFrame:
    """Roles without one that is neither built in nor used."""
    used = users.where(F.col("role_id") == role_id).select(F.col("role_id").alias("id")).distinct()
    gone = roles.where((F.col("id") == role_id) & ~F.col("is_system")).join(used, "id", "left_anti").select("id")
    return roles.join(gone, "id", "left_anti")


def role_cloned(role_permissions: DataFrame, source_id: int, new_id: int) -> DataFrame:
    return role_permissions.unionByName(role_permissions.where(F.col("role_id") == source_id).withColumn("role_id", F.lit(new_id).cast("long")))


def login_succeeded(users: DataFrame, user_id: int) -> DataFrame:
    here = F.col("id") == user_id
    return users.withColumns({"failed_logins": F.when(here, 0).otherwise(F.col("failed_logins")), "locked_until": F.when(here, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("locked_until"))})


def login_failed(users: DataFrame, user_id: int, now: Column, threshold: int = 5, minutes: int = 15) -> DataFrame:
    """One more failure; from the threshold on it locks. An expired lock does not reset the number."""
    here = F.col("id") == user_id
    n = F.coalesce("failed_logins", F.lit(0)) + 1
    until = F.when(n >= threshold, now + F.expr(f"interval {int(minutes)} minutes")).otherwise(F.col("locked_until"))
    return users.withColumns({"locked_until": F.when(here, until).otherwise(F.col("locked_until")), "failed_logins": F.when(here, n).otherwise(F.col("failed_logins"))})


def password_reset(users: DataFrame, sessions: DataFrame, user_id: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """A new token version, and all the user's sessions revoked."""
    bumped = users.withColumn("token_version", F.when(F.col("id") == user_id, F.col("token_version") + 1).otherwise(F.col("token_version")))
    return bumped, revoked(sessions, F.col("user_id") == user_id, now)


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions neither revoked nor expired; newest first by session_order()."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def session_order() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]


def revoked(sessions: DataFrame, which: Column, now: Column) -> DataFrame:
    return sessions.withColumn("revoked_at", F.when(which & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at")))


def reused_tokens(refreshes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Users whose revoked token was presented again: their sessions are to be revoked. refreshes: (token, at).

    A token was presented after a revocation just when its last presentation was, so that each token, and each user's first
    revocation of it, is one row of the join.
    """
    shown = refreshes.groupBy("token").agg(F.max("at").alias("at")).select(F.sha2("token", 256).alias("token_hash"), "at")
    gone = sessions.where("revoked_at is not null").groupBy("token_hash", "user_id").agg(F.min("revoked_at").alias("revoked_at"))
    return shown.join(gone, "token_hash").where("at >= revoked_at").select("user_id").distinct()


def swept(flows: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """Pending flows that are not older than their time to live."""
    return flows.where(F.timestamp_diff("SECOND", F.col("created_at"), now) <= ttl_s)


def audit_entry(rows: DataFrame, detail: list[str]) -> DataFrame:
    """rows with their detail columns as one JSON text."""
    return rows.withColumn("detail", F.to_json(F.struct(*detail))).drop(*detail)


def audit_log(log: DataFrame, users: DataFrame, user_id: int | None = None, action_prefix: str = "", date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Entries with the user's address. The prefix is a LIKE pattern, so its % and _ are wildcards; both dates are inclusive. audit_order() sorts them."""
    rows = log
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if action_prefix:
        rows = rows.where(F.col("action").like(f"{action_prefix}%"))
    if date_from is not None:
        rows = rows.where(F.col("created_at") >= date_from)
    if date_to is not None:
        rows = rows.where(F.col("created_at") <= date_to)
    return rows.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id", "left")


def audit_order() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
