"""Checks of names, paths and sensor settings."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column

# What names may hold, and the settings that must be above zero.
INTERFACE_NAME = r"^[A-Za-z0-9._:-]{1,15}$"
DEVICE_PATH = r"^/dev/[A-Za-z0-9/_-]*$"
ABOVE_ZERO = (
    "kernel.igmp_correlation_window_ms", "kernel.suspicious_rtt_ms", "network.ntp_shift_threshold_secs", "network.tls_flag_count_after_ntp",
    "hardware.nvme_baseline_latency_us", "hardware.nvme_deviation_threshold_pct", "hardware.mac_flap_threshold", "hardware.mac_flap_window_secs",
)
SOCKETS = ("sentinel.ws_listen_addr", "dashboard.listen_addr")


def is_interface_name(name: Column) -> Column:
    """Whether a text names a network interface: 1 to 15 letters, digits, dots, colons, dashes and underscores."""
    return name.rlike(INTERFACE_NAME) & ~name.contains("\n")


def is_device_path(path: Column) -> Column:
    """Whether a text is the path of a device: below /dev, without dots."""
    return path.rlike(DEVICE_PATH) & ~path.contains("\n")


def _is_socket(text: str) -> bool:
    host, colon, port = text.rpartition(":")
    try:
        # an IPv6 address stands in brackets
        bracketed = host.startswith("[") and host.endswith("]")
        version = ipaddress.ip_address(host[1:-1] if bracketed else host).version
    except ValueError:
        return False
    return bool(colon) and bracketed == (version == 6) and port.isascii() and port.isdigit() and int(port) < 1 << 16


def setting_problems(settings: dict[str, object]) -> list[str]:
    """What is wrong with sensor settings by dotted name; names left out are not checked."""
    import re

    out = [f"{name} must be above 0" for name in ABOVE_ZERO if name in settings and not settings[name] > 0]
    if ".." in str(settings.get("network.zeek_socket_path", "")):
        out.append("network.zeek_socket_path must not contain '..'")
    if "sentinel.panic_interface" in settings and not re.fullmatch(INTERFACE_NAME[1:-1], str(settings["sentinel.panic_interface"])):
        out.append("sentinel.panic_interface is no interface name")
    return out + [f"{name} is no address and port" for name in SOCKETS if name in settings and not _is_socket(str(settings[name]))]
