"""Packet decoding, filters and counters over binary headers or parsed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
ICMP, TCP, UDP = 1, 6, 17
DNS = 53


def uint(data: Column, at: int, size: int) -> Column:
    """ST11: unsigned number of size bytes (1 to 7) in network order; at counts from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def mac(data: Column, at: int) -> Column:
    """ST10: a hardware address in colon notation."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.lower(F.hex(F.substring(data, k + at + 1, F.lit(1))))), ":")


def dotted(data: Column, at: int) -> Column:
    """ST10: an IPv4 address in dotted notation."""
    return F.concat_ws(".", *[uint(data, at + k, 1).cast("string") for k in range(4)])


def decoded(frames: DataFrame, data: str) -> DataFrame:
    """M15: Ethernet and IPv4 headers as columns (null where the frame has none)."""
    d = F.col(data)
    v4 = uint(d, 12, 2) == IPV4
    head = (uint(d, 14, 1).bitwiseAND(F.lit(15)) * 4).cast("int")
    port = lambda k: F.conv(F.hex(F.substring(d, head + 15 + k, F.lit(2))), 16, 10).cast("long")
    has_ports = v4 & uint(d, 23, 1).isin(TCP, UDP)
    return frames.withColumns({"ethertype": uint(d, 12, 2), "src_mac": mac(d, 6), "dst_mac": mac(d, 0), "ip_proto": F.when(v4, uint(d, 23, 1)), "frag_offset": F.when(v4, uint(d, 20, 2).bitwiseAND(F.lit(0x1FFF))), "src_ip": F.when(v4, dotted(d, 26)), "dst_ip": F.when(v4, dotted(d, 30)), "src_port": F.when(has_ports, port(0)), "dst_port": F.when(has_ports, port(2))})


def is_dns() -> Column:
    """PF12: UDP from or to port 53, in IPv6 or an unfragmented IPv4 packet; on parsed columns, so it is pushed into the scan."""
    whole = (F.col("ethertype") == IPV6) | ((F.col("ethertype") == IPV4) & (F.col("frag_offset") == 0))
    return whole & (F.col("ip_proto") == UDP) & ((F.col("src_port") == DNS) | (F.col("dst_port") == DNS))


def protocol(ethertype: Column, ip_proto: Column) -> Column:
    """PF13: arp, icmp, tcp, udp, other ip, rest."""
    ip = F.when(ip_proto == ICMP, "icmp").when(ip_proto == TCP, "tcp").when(ip_proto == UDP, "udp").otherwise("other_ip")
    return F.when(ethertype == ARP, "arp").when(ethertype == IPV4, ip).otherwise("rest")


def protocol_counts(packets: DataFrame, proto: str) -> DataFrame:
    """AG3: counters of one pass; ip holds icmp, tcp, udp and other ip; total is arp, ip and the rest."""
    p = F.col(proto)
    ip = p.isin("icmp", "tcp", "udp", "other_ip")
    return packets.agg(*[F.count_if(p == k).alias(k) for k in ("arp", "icmp", "tcp", "udp")], F.count_if(ip).alias("ip"), F.count_if(p == "rest").alias("rest"), F.count(p).alias("total"))


def is_arp_reply(opcode: Column) -> Column:
    """PF14."""
    return opcode == 2


def replies(requests: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """JN14, MA17, B10: answers with their request by id and source, and the time between, receive less send."""
    return requests.join(answers, on).withColumn("rtt", F.col("received") - F.col("sent"))
