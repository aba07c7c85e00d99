"""A deterministic sample of six sources with planted attacks, made on the cluster: every event follows from its number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions.leaves import body
from quietlog.model import LogSource, Source

SOURCES = [
    Source("windows-security", LogSource("windows", "security"), schema="sigma"), Source("sysmon", LogSource("windows", "sysmon"), schema="sigma"),
    Source("linux-auth", LogSource("linux", "auth"), text_field="message", schema="sigma"), Source("firewall", LogSource("opnsense", "filterlog", "firewall"), schema="sigma"),
    Source("dns", LogSource("unbound", None, "dns"), schema="sigma"), Source("nginx", LogSource("nginx", "access"), text_field="message", schema="sigma"),
]
START = 1_791_619_200  # 2026-10-10T08:00:00Z
#: (source, kind, events an hour at scale 100)
KINDS = [
    ("windows-security", "4624", 6000), ("windows-security", "4634", 5000), ("windows-security", "4672", 800), ("windows-security", "5156", 12000), ("windows-security", "4625", 60),
    ("sysmon", "1", 1500), ("sysmon", "3", 4000), ("sysmon", "7", 15000), ("sysmon", "10", 3000), ("sysmon", "11", 2000), ("sysmon", "22", 3000),
    ("linux-auth", "cron", 3000), ("linux-auth", "accepted", 900), ("linux-auth", "sudo", 150), ("firewall", "pass", 8000), ("firewall", "block", 2000), ("dns", "query", 6000), ("nginx", "get", 5000), ("nginx", "health", 3000),
]


def draw(seed: int, salt: str, n: int, number: str = "n") -> Column:
    """A number in 0 .. n-1 that follows from the event's number, the seed and a word."""
    return F.pmod(F.xxhash64(F.col(number), F.lit(seed), F.lit(salt)), F.lit(n))


def pick(seed: int, salt: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(seed, salt, len(values)) + 1).cast("int"))


def background(spark: SparkSession, source: str, kind: str, rate: int, seed: int, seconds: int, scale: int) -> DataFrame:
    many = rate * scale * seconds // 360_000
    df = spark.range(many).select(F.col("id").alias("n"), (START + draw_id(seed, source + kind, seconds)).alias("at"))
    host = pick(seed, "host", ["ws-01", "ws-02", "ws-03", "srv-db", "srv-web"])
    user = pick(seed, "user", ["anna", "ben", "carla", "deniz", "emil", "svc-backup"])
    ip = F.concat(F.lit("10.0."), draw(seed, "net", 4).cast("string"), F.lit("."), (draw(seed, "ip", 200) + 1).cast("string"))
    port = (draw(seed, "port", 40000) + 20000).cast("string")
    clock = F.date_format(F.timestamp_seconds("at"), "MMM d HH:mm:ss")
    agent = F.struct(F.lit("filebeat").alias("type"), F.lit("8.15.0").alias("version"))
    fields: dict[str, Column] = {"@timestamp": F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    if source in ("windows-security", "sysmon"):
        channel = "Security" if source == "windows-security" else "Microsoft-Windows-Sysmon/Operational"
        fields |= {"agent": agent, "EventID": F.lit(int(kind)), "Channel": F.lit(channel), "Provider": F.lit(channel.split("/")[0]), "Computer": host, "Level": F.lit("Information"), "RecordNumber": F.col("n") + 100_000}
        if kind in ("4624", "4625", "4634", "4672"):
            fields |= {"TargetUserName": user, "TargetDomainName": F.lit("CORP"), "SubjectUserName": F.concat(host, F.lit("$")), "LogonType": F.element_at(F.array(F.lit(3), F.lit(2), F.lit(5)), (draw(seed, "lt", 3) + 1).cast("int")), "IpAddress": ip, "IpPort": port, "WorkstationName": F.lit("")}
            if kind == "4625":
                fields |= {"Status": F.lit("0xc000006d"), "FailureReason": F.lit("%%2313")}
        elif kind == "5156":
            fields |= {"Application": F.lit("\\device\\harddiskvolume2\\windows\\system32\\svchost.exe"), "Direction": F.lit("%%14593"), "SourceAddress": ip, "SourcePort": port, "DestAddress": F.lit("10.0.0.5"), "DestPort": F.lit("443"), "Protocol": F.lit("6")}
        else:
            image = pick(seed, "image", ["C:\\Windows\\System32\\svchost.exe", "C:\\Windows\\explorer.exe", "C:\\Program Files\\App\\app.exe"])
            fields |= {"RuleName": F.lit("-"), "Image": image, "User": F.concat(F.lit("CORP\\"), user), "Description": F.lit("")}
            fields |= {"1": {"CommandLine": F.concat(image, F.lit(" -k")), "IntegrityLevel": F.lit("Medium")}, "3": {"DestinationIp": ip, "DestinationPort": port}, "7": {"ImageLoaded": F.lit("C:\\Windows\\System32\\kernel32.dll"), "Signed": F.lit("true"), "Signature": F.lit("Microsoft Windows")},
                       "10": {"SourceImage": image, "TargetImage": F.lit("C:\\Windows\\System32\\lsass.exe"), "GrantedAccess": F.lit("0x1000")}, "11": {"TargetFilename": F.concat(F.lit("C:\\Temp\\"), draw(seed, "f", 9999).cast("string"))}, "22": {"QueryName": F.concat(user, F.lit(".corp.example")), "QueryStatus": F.lit("0")}}[kind]
    elif source == "firewall":
        fields |= {"observer": F.struct(F.lit("fw-1").alias("hostname"), F.lit("opnsense").alias("vendor")), "action": F.lit(kind), "direction": F.lit("in"), "reason": F.lit("match"), "proto": F.lit("tcp"), "src_ip": ip, "src_port": port, "dst_ip": F.lit("10.0.0.5"), "dst_port": F.lit(443), "tcp_flags": F.lit("S"), "ecn": F.lit("")}
    elif source == "dns":
        fields |= {"resolver": F.lit("unbound"), "client": F.struct(ip.alias("ip"), F.lit(53).alias("port")), "query": F.struct(F.concat(user, F.lit(".example.net")).alias("name"), F.lit("A").alias("type")), "response_code": F.lit("NOERROR"), "dnssec": F.lit("")}
    else:
        pid = (draw(seed, "pid", 9000) + 1000).cast("string")
        line = {
            "cron": F.concat(clock, F.lit(" bastion CRON["), pid, F.lit("]: pam_unix(cron:session): session opened for user root(uid=0)")),
            "accepted": F.concat(clock, F.lit(" bastion sshd["), pid, F.lit("]: Accepted publickey for "), user, F.lit(" from "), ip, F.lit(" port "), port, F.lit(" ssh2")),
            "sudo": F.concat(clock, F.lit(" bastion sudo: "), user, F.lit(" : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/usr/bin/apt")),
            "get": F.concat(ip, F.lit(' - - "GET /page/'), draw(seed, "page", 500).cast("string"), F.lit(' HTTP/1.1" 200 '), port),
            "health": F.concat(F.lit('10.0.0.9 - - "GET /health HTTP/1.1" 200 2')),
        }[kind]
        fields |= {"message": line, "input": F.struct(F.lit("log").alias("type"))}
    return df.select(F.lit(source).alias("source"), "at", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("text"), F.concat(F.lit(kind + ":"), F.format_string("%012d", F.col("n"))).alias("line"))


def draw_id(seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))


def planted(spark: SparkSession, seconds: int) -> DataFrame:
    """Six attacks, a handful of rows: a logon burst, an opened LSASS, whoami and encoded PowerShell, an SSH brute force with a login, a bad domain, path traversal."""
    import json

    rows: list[tuple[str, int, str, str]] = []
    mid = START + seconds // 2

    def add(source: str, at: int, line: str, **fields: object) -> None:
        rows.append((source, at, json.dumps(fields), line))

    win = {"Channel": "Security", "Computer": "ws-02"}
    for i in range(12):
        add("windows-security", mid + 4 * i, f"x:burst:{i:03}", EventID=4625, TargetUserName="admin", IpAddress="203.0.113.7", Status="0xc000006a", **win)
    add("sysmon", mid + 100, "x:lsass", EventID=10, SourceImage="C:\\Temp\\dump.exe", TargetImage="C:\\Windows\\System32\\lsass.exe", GrantedAccess="0x1010", Computer="ws-02")
    add("sysmon", mid + 200, "x:whoami", EventID=1, Image="C:\\Windows\\System32\\whoami.exe", CommandLine="whoami /all", Computer="ws-02")
    add("sysmon", mid + 205, "x:powershell", EventID=1, Image="C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", CommandLine="powershell -enc SQBFAFgA", Computer="ws-02")
    for i in range(30):
        add("linux-auth", mid + 300 + i, f"x:ssh:{i:03}", message=f"Oct 10 09:00:{i:02} bastion sshd[4242]: Failed password for root from 203.0.113.9 port 4{i:03} ssh2")
    add("linux-auth", mid + 331, "x:ssh:in", message="Oct 10 09:00:31 bastion sshd[4242]: Accepted password for root from 203.0.113.9 port 4999 ssh2")
    add("dns", mid + 400, "x:dns", resolver="unbound", client={"ip": "10.0.1.7", "port": 53}, query={"name": "evil.bad-domain.example", "type": "A"})
    for i in range(4):
        add("nginx", mid + 500 + i, f"x:traverse:{i}", message=f'203.0.113.9 - - "GET /../../etc/passwd{i} HTTP/1.1" 404 0')
    return spark.createDataFrame(rows, "source string, at long, text string, line string")


def generate(spark: SparkSession, seed: int = 1, seconds: int = 3600, scale: int = 100) -> DataFrame:
    """Events (event_id, ts, source, body): stable order of time, source and line."""
    from pyspark.sql import Window

    out = planted(spark, seconds)
    for source, kind, rate in KINDS:
        if rate * scale * seconds // 360_000:
            out = out.unionByName(background(spark, source, kind, rate, seed, seconds, scale))
    minute = F.floor(F.col("at") / 60)
    counts = out.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("rows_in"))
    before = counts.select("minute", (F.sum("rows_in").over(Window.partitionBy(F.lit(0)).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_in")).alias("before"))
    place = F.row_number().over(Window.partitionBy("minute").orderBy("at", "source", "line")) - 1
    out = out.withColumn("minute", minute).withColumn("place", place).join(F.broadcast(before), "minute")
    return out.select((F.col("before") + F.col("place")).alias("event_id"), F.timestamp_seconds("at").alias("ts"), "source", body(F.col("text")).alias("body"), "line")
