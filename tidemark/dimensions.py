"""Names, lists and thresholds that results depend on."""

# Protocol names by number.
PROTOCOLS = {
    0: "IP", 1: "ICMP", 2: "IGMP", 3: "GGP", 4: "IP-IN-IP", 5: "ST", 6: "TCP", 7: "CBT", 8: "EGP", 9: "IGP",
    10: "BBN_RCC_MON", 11: "NVP_II", 12: "PUP", 13: "ARGUS", 14: "EMCON", 15: "XNET", 16: "CHAOS", 17: "UDP", 18: "MUX", 19: "DCN_MEAS",
    20: "HMP", 21: "PRM", 22: "XNS_IDP", 23: "TRUNK_1", 24: "TRUNK_2", 25: "LEAF_1", 26: "LEAF_2", 27: "RDP", 28: "IRTP", 29: "ISO_TP4",
    30: "NETBLT", 31: "MFE_NSP", 32: "MERIT_INP", 33: "DCCP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 112: "VRRP", 132: "SCTP",
}

# Ports of known services.
SERVICE_PORTS = (
    20, 21, 22, 25, 53, 80, 110, 143, 443, 444, 445, 465, 514, 587, 993, 1433, 3306, 3389, 5432, 5984, 6379, 8000, 8080, 8443, 8888, 9200, 27017,
)

# TCP flag bits.
FLAG_BITS = {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8, "urg": 32}

# Features whose joint deviation confirms an alert, by family; the first family with enough hits names it.
CONSENSUS_FAMILIES = {
    "volume_flood": ["total_pps_log", "total_bytes_log", "flag_syn_ratio", "flag_rst_ratio", "pps_momentum", "vel_pps_z", "vel_bytes_z", "vel_syn_z"],
    "slow_attack": ["flow_duration", "iat_mean", "payload_continuity", "flag_fin_ratio"],
    "exfiltration": ["payload_continuity_ratio", "entropy_avg", "bytes_velocity", "flag_psh_ratio"],
    "kinematics": ["pps_velocity", "bytes_velocity", "pps_acceleration", "bytes_acceleration", "pps_volatility", "bytes_volatility"],
    "recon": ["port_scan_ratio", "unique_dst_ports", "flag_fin_ratio", "flag_urg_ratio"],
}

# Features that are projected together, by family.
FEATURE_FAMILIES = {
    "volume": ["total_pps_log", "total_bytes_log", "bytes", "pps_velocity", "bytes_velocity", "pps_acceleration", "bytes_acceleration", "pps_volatility", "bytes_volatility", "pps_momentum", "vel_pps_z", "vel_bytes_z"],
    "payload": ["size_avg", "entropy_avg", "size_max", "payload_continuity", "payload_continuity_ratio", "entropy_velocity", "entropy_acceleration", "entropy_volatility"],
    "flags": ["flag_syn_ratio", "flag_ack_ratio", "flag_fin_ratio", "flag_rst_ratio", "flag_psh_ratio", "flag_urg_ratio", "vel_syn_z"],
    "protocol": ["icmp_ratio", "udp_ratio", "tcp_ratio", "igmp_ratio"],
    "connection": ["unique_dst_ports", "port_scan_ratio", "burst_factor", "flow_duration", "iat_mean"],
}

# Share of variance that a family's components keep.
FAMILY_VARIANCE = {"volume": 0.95, "payload": 0.99, "flags": 0.99, "protocol": 0.99, "connection": 0.95}

# Words in a feature's name that tell its family, tried in this order.
FAMILY_WORDS = {
    "flags": ["flag_", "syn", "rst", "fin", "ack", "urg", "psh"],
    "volume": ["bytes", "pps", "traffic", "bandwidth", "burst"],
    "payload": ["payload", "entropy", "size", "max", "min"],
    "protocol": ["protocol", "udp", "tcp", "icmp", "ttl", "dns"],
    "connection": ["port_scan", "unique_dst", "connection", "flow", "iat", "duration"],
    "kinematics": ["velocity", "acceleration", "momentum", "volatility", "vel_"],
}

# Fixed values: (feature, tactic, technique), in order of the map.
TECHNIQUES = [
    ("flag_syn_ratio", "Impact", "T1498.001 – DoS: Direct Network Flood (SYN Flood)"),
    ("flag_rst_ratio", "Impact", "T1499.002 – DoS: Endpoint Service (RST Flood)"),
    ("flag_fin_ratio", "Reconnaissance", "T1595 – Active Scanning (Stealth FIN Scan)"),
    ("flag_ack_ratio", "Reconnaissance", "T1571 – Non-Standard Port Communication"),
    ("connection_rate", "Impact", "T1499.003 – DoS: Application Boundary Flood"),
    ("traffic_volume_spike", "Impact", "T1498 – Network Denial of Service (Volumetric)"),
    ("burst_factor_anomaly", "Impact", "T1498.002 – DoS: Reflection / Amplification"),
    ("port_scan_ratio", "Reconnaissance", "T1595.001 – Active Scanning: IP Addresses"),
    ("entropy_anomaly", "Command & Control", "T1573.001 – Encrypted Channel: Symmetric Crypto"),
    ("entropy_volatility", "Command & Control", "T1573 – Encrypted / Obfuscated Traffic"),
    ("packet_size_anomaly", "Command & Control", "T1001.003 – Data Obfuscation: Protocol Impersonation"),
    ("dns_spike", "Command & Control", "T1071.004 – Application Layer Protocol: DNS"),
    ("beaconing_cadence", "Command & Control", "T1071 – Application Layer C2 Heartbeat"),
    ("bytes_out_ratio", "Exfiltration", "T1020 – Automated Exfiltration"),
    ("payload_volume_spike", "Exfiltration", "T1048 – Exfiltration Over Alternative Protocol"),
    ("protocol_anomaly", "Defense Evasion", "T1001.001 – Data Steganography / Protocol Tunneling"),
    ("ttl_anomaly", "Defense Evasion", "T1562.001 – Impair Defenses"),
    ("bytes_volatility", "Impact", "T1498 – Resource Exhaustion: Bandwidth Volatility"),
    ("payload_continuity", "Command & Control", "T1573 – Encrypted / Obfuscated Traffic"),
    ("pps_volatility", "Impact", "T1498 – Volumetric PPS Volatility"),
    ("flow_duration", "Impact", "T1190 – Exploit Public-Facing Application (Slow DoS)"),
    ("iat_mean", "Command & Control", "T1071 – Beaconing / Irregular IAT"),
    ("size_max", "Exfiltration", "T1048 – Oversized Packet Exfiltration"),
    ("unique_dst_ports", "Reconnaissance", "T1046 – Network Service Discovery"),
    ("udp_ratio", "Impact", "T1498.001 – UDP Flood / Amplification"),
]

# Risk labels by severity.
RISK_LABELS = {1: "Low — Single-tier detection", 2: "High — Majority consensus", 3: "Critical — Full unanimity"}

# Weights of the tiers in an incident's confidence.
TIER_WEIGHTS = {"BallTree": 0.20, "GMM": 0.25, "IForest": 0.20, "PhysicalSentinel": 0.20, "VelocityBypass": 0.15}

# Features of rates of change that bypass the other tiers, in order of precedence, and severities by z.
VELOCITY_FEATURES = ("vel_pps_z", "vel_bytes_z", "vel_syn_z")
VELOCITY_SEVERITIES = ((12.0, 3), (8.0, 2), (5.0, 1))

# Parts of names that select a window's features, and features selected by name.
FEATURE_PARTS = (
    "_ratio", "_log", "avg", "factor", "velocity", "acceleration", "volatility", "momentum", "flow_duration", "payload_continuity", "iat_mean", "payload_continuity_ratio", "server_port", "vel_",
)
FEATURE_NAMES = ("size_max", "unique_dst_ports", "bytes")
METADATA = ("_abs_timestamp", "server_port")
