"""Column functions on addresses, ports and TCP flags. IPv4 addresses are unsigned values in a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCP flag bits.
FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128, "NS": 256}
#: Private and loopback networks, and UDP ports of ordinary local services.
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")
SERVICE_PORTS = (53, 67, 68, 123, 5353, 1900)


def canonical_key(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column) -> Column:
    """The two endpoints, lower first: struct of low_ip, low_port, high_ip, high_port."""
    a, b = F.struct(ip_a.alias("ip"), port_a.alias("port")), F.struct(ip_b.alias("ip"), port_b.alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.struct(low["ip"].alias("low_ip"), low["port"].alias("low_port"), high["ip"].alias("high_ip"), high["port"].alias("high_port"))


def destination_port(key: Column, forward_ip: Column, forward_port: Column) -> Column:
    """Port of the endpoint that is not the forward source."""
    from_low = (key["low_ip"] == forward_ip) & (key["low_port"] == forward_port)
    return F.when(from_low, key["high_port"]).otherwise(key["low_port"])


def ip_to_long(text: Column) -> Column:
    """Value of a dotted address; null unless it has four parts of 0 to 255."""
    parts = F.split(text, r"\.")
    value = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("int").cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0).cast("long"))
    ok = F.rlike(text, F.lit(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")) & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok, value)


def long_to_ip(value: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(value, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)])


def network_range(cidr: str) -> tuple[int, int]:
    """First and last address of a network."""
    address, bits = cidr.split("/")
    value = sum(int(p) << 8 * (3 - k) for k, p in enumerate(address.split(".")))
    size = 1 << (32 - int(bits))
    return value // size * size, value // size * size + size - 1


def in_networks(ip: Column, cidrs=PRIVATE_NETWORKS) -> Column:
    out = F.lit(False)
    for lo, hi in map(network_range, cidrs):
        out = out | ip.between(lo, hi)
    return out


def same_network(ip_a: Column, ip_b: Column, cidr: str) -> Column:
    """Both endpoints lie in one network."""
    lo, hi = network_range(cidr)
    return ip_a.between(lo, hi) & ip_b.between(lo, hi)


def is_noise(destination_ip: Column, destination_port: Column, protocol: Column) -> Column:
    """Multicast, or UDP to an ordinary local service."""
    return destination_ip.startswith("224.") | destination_ip.startswith("239.") | ((protocol == 17) & destination_port.isin(*SERVICE_PORTS))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def lifecycle(protocol: Column, resets: Column, fin_forward: Column, fin_reverse: Column) -> Column:
    """One of tcp_reset, tcp_fin_handshake, tcp_other, udp."""
    return F.when(protocol == 17, "udp").when(resets > 0, "tcp_reset").when(fin_forward & fin_reverse, "tcp_fin_handshake").otherwise("tcp_other")
