"""The shipped rules as data, by source."""

from __future__ import annotations

from dataclasses import replace

from gaugeframe.operators.rules import (
    KeyComparison,
    KeyExpected,
    MetadataComparison,
    MetadataExpected,
    MetricComparison,
    PointThreshold,
    PreemptionRule,
    RunComparison,
    StackThreshold,
    StatThreshold,
)

#: Scores by name.
CRITICAL, BAD, POOR, CONCERNING, NEUTRAL, GOOD = -256, -16, -2, -1, 0, 1

#: Name, metric, statistic, comparison, threshold, score (and whether the change's size alone counts).
COMPARISONS = {
    "cpu_utilization": [
        ("Consistent CPU Utilization", "aggregate", "avg", "<=", 0.01, GOOD, True),
        ("Increased User-Space CPU Utilization", "user", "avg", ">=", 0.1, POOR, False),
        ("Decreased User-Space CPU Utilization", "user", "avg", "<=", -0.1, POOR, False),
        ("Increased I/O Wait Time", "iowait", "avg", ">=", 0.1, POOR, False),
    ],
    "vmstat": [("Increased Minor Page Faults", "pgminorfault", "avg", ">=", 0.2, CONCERNING, False), ("Increased Major Page Faults", "pgmajfault", "avg", ">=", 0.2, POOR, False)],
    "meminfo": [("Inconsistent Physical Memory", "MemTotal", "avg", ">=", 0.1, CRITICAL, True), ("Reduced Memory Availability", "MemAvailable", "avg", "<=", -0.1, POOR, False)],
    "netstat": [("Inconsistent Inbound Network Traffic", "IpExt:InOctets", "avg", ">=", 0.1, BAD, True), ("Inconsistent Outbound Network Traffic", "IpExt:OutOctets", "avg", ">=", 0.1, BAD, True)],
    "efa_stat": [("Inconsistent Inbound EFA Traffics", "rx_bytes", "avg", ">", 0.1, CRITICAL, True), ("Inconsistent Outbound EFA Traffics", "tx_bytes", "avg", ">", 0.1, CRITICAL, True)],
    "perf_stat": [("Reduced Instructions per Cycle", "ipc", "avg", "<=", -0.1, POOR, False)],
}
THRESHOLDS = {
    "cpu_utilization": [("Underutilized CPU", "idle", "avg", ">", 50, CRITICAL)],
    "vmstat": [("Excessive Page Fault Rate", "pgfault", "p99", ">", 100000, CONCERNING)],
    "ena_stat": [("High SRD Resource Utilization", "ena_srd_resource_utilization", "p99", ">", 95, POOR)],
    "efa_stat": [("Unused RDMA Read", "rdma_read_wrs", "max", "=", 0, CONCERNING), ("Unused RDMA Write", "rdma_write_wrs", "max", "=", 0, CONCERNING)],
    "perf_stat": [("High Branch Mispredictions", "branch-mpki", "avg", ">=", 10, CONCERNING)],
    "self_stats": [("High Recorder Userspace CPU Time", "process_user_space_time", "p90", ">", 0.01, CRITICAL), ("High Recorder Kernelspace CPU Time", "process_kernel_space_time", "p90", ">", 0.04, CRITICAL)],
}
#: Name, pattern of metrics, comparison, threshold, score.
POINTS = {
    "vmstat": [("Major Page Faults Detected", "^pgmajfault$", ">", 0, POOR)],
    "ena_stat": [
        ("Inbound Bandwidth Exceeded Instance Allowance", "^bw_in_allowance_exceeded$", ">", 0, CRITICAL),
        ("Outbound Bandwidth Exceeded Instance Allowance", "^bw_out_allowance_exceeded$", ">", 0, CRITICAL),
        ("PPS Exceeded Instance Allowance", "^pps_allowance_exceeded$", ">", 0, CRITICAL),
        ("Connection Tracking Exceeded Instance Allowance", "^conntrack_allowance_exceeded$", ">", 0, CRITICAL),
        ("Link-Local Service Exceeded Instance Allowance", "^linklocal_allowance_exceeded$", ">", 0, CRITICAL),
        ("Disabled ENA Express", "^ena_srd_mode$", "=", 0, CONCERNING),
        ("Enabled ENA Express without UDP", "^ena_srd_mode$", "=", 1, CONCERNING),
        ("Disabled ENA Express with Previously Enabled UDP", "^ena_srd_mode$", "=", 2, BAD),
        ("ENA Express Enabled with UDP", "^ena_srd_mode$", "=", 3, GOOD),
    ],
    "efa_stat": [("EFA Errors", "_err$", ">=", 1, POOR)],
    "perf_stat": [
        ("High L1 Instruction Cache Misses", "^inst-l1-mpki$", ">", 20, CONCERNING),
        ("Instruction TLB Misses", "^inst-tlb-mpki$", ">", 0, CONCERNING),
        ("Instruction TLB Table Walks", "^inst-tlb-tw-pki$", ">", 0, CONCERNING),
        ("High Code Sparsity", "^code-sparsity$", ">", 0.5, BAD),
        ("High L1 Data Cache Misses", "^data-l1-mpki$", ">", 20, CONCERNING),
        ("High L2 Cache Misses", "^l2-mpki$", ">", 10, CONCERNING),
        ("High L3 Cache Misses", "^l3-mpki$", ">", 10, BAD),
        ("Data TLB Misses", "^data-tlb-mpki$", ">", 0, CONCERNING),
        ("Data TLB Table Walks", "^data-tlb-tw-pki$", ">", 0, CONCERNING),
        ("Old-Style Atomic Instructions", "^strex-spec-pki$", ">=", 10, POOR),
        ("PMU Counter Collection Multiplexing", "^mux_counter_schedule_rate$", "<", 100, CONCERNING),
    ],
}
#: Name, base metric, metric, statistic, comparison, threshold, score.
PAIRS = {
    "ena_stat": [("Low SRD Usage Rate", "ena_srd_tx_pkts", "ena_srd_eligible_tx_pkts", "avg", ">=", 0.3, POOR)],
    "perf_stat": [
        ("Frontend-Dominated CPU Stalls", "stall-backend-pkc", "stall-frontend-pkc", "avg", ">=", 0.1, CONCERNING),
        ("Backend-Dominated CPU Stalls", "stall-frontend-pkc", "stall-backend-pkc", "avg", ">=", 0.1, CONCERNING),
    ],
}
#: Fixed value: the pattern of frames that make exceptions.
EXCEPTIONS = r"java\.lang\.(Throwable\.(fillInStackTrace|getStackTrace|getOurStackTrace)|StackTraceElement\.<init>)|\w+(\.\w+)*\.((\w*Exception|\w*Error|Throwable)\.<init>)"
OTHERS = {
    "systeminfo": [KeyComparison("Kernel Version Mismatch", "Kernel Version", CRITICAL), KeyComparison("Inconsistent Number of CPUs", "CPUs", CRITICAL)],
    "kernel_config": [KeyExpected("Huge Page Disabled", "CONFIG_TRANSPARENT_HUGEPAGE", "y", POOR), PreemptionRule()],
    "java_profile": [
        StackThreshold("Excessive Exceptions", ((EXCEPTIONS,),), 5.0, CRITICAL, (0,), profile_type="cpu"),
        MetadataExpected("Tiered Compilation Check", "jvmArguments", r".*-XX:(-|\+)TieredCompilation.*", POOR, group="jdk.JVMInformation"),
        MetadataComparison("JVM Version Comparison", "jvmVersion", CRITICAL, group="jdk.JVMInformation"),
    ],
}


#: What a finding of a rule means and what to look at, by the rule's name.
MESSAGES = {
    "Consistent CPU Utilization": "Both runs used the CPUs alike, so their figures can be compared.",
    "Increased User-Space CPU Utilization": "More time went into application code. Compare the profiles of both runs and the amount of work.",
    "Decreased User-Space CPU Utilization": "Less time went into application code. See whether the load was the same, or whether something else held it up.",
    "Increased I/O Wait Time": "CPUs waited longer for devices. Look at the disk figures of both runs.",
    "Underutilized CPU": "CPUs idled most of the time, so other figures may say little. See whether the load reached this host.",
    "Increased Minor Page Faults": "Memory is mapped more often. Look at how the application allocates, and at huge pages.",
    "Increased Major Page Faults": "Pages are read back from disk more often. See whether memory is short.",
    "Excessive Page Fault Rate": "Page faults are very frequent. Reusing memory or huge pages may help.",
    "Major Page Faults Detected": "Pages had to be read from disk. See whether memory is short, or whether files are mapped for the first time.",
    "Inconsistent Physical Memory": "The runs had different amounts of memory, so they can hardly be compared.",
    "Reduced Memory Availability": "Less memory was free than in the base run.",
    "Inconsistent Inbound Network Traffic": "The runs received different amounts of data; the load may not have been the same.",
    "Inconsistent Outbound Network Traffic": "The runs sent different amounts of data; the load may not have been the same.",
    "Inconsistent Inbound EFA Traffics": "The runs received different amounts of data on the fabric adapter.",
    "Inconsistent Outbound EFA Traffics": "The runs sent different amounts of data on the fabric adapter.",
    "Unused RDMA Read": "No remote reads were made although the adapter offers them. Check the library's settings.",
    "Unused RDMA Write": "No remote writes were made although the adapter offers them. Check the library's settings.",
    "EFA Errors": "The fabric adapter counted errors. Look at its log.",
    "Low SRD Usage Rate": "Few of the packets that could take the express path took it.",
    "High SRD Resource Utilization": "The express path is close to its limit.",
    "Inbound Bandwidth Exceeded Instance Allowance": "Packets were held back since inbound traffic went above what the instance may use.",
    "Outbound Bandwidth Exceeded Instance Allowance": "Packets were held back since outbound traffic went above what the instance may use.",
    "PPS Exceeded Instance Allowance": "Packets were held back since there were more a second than the instance may handle.",
    "Connection Tracking Exceeded Instance Allowance": "No more connections could be tracked, so new ones were refused.",
    "Link-Local Service Exceeded Instance Allowance": "Requests to local services such as names, time and metadata were dropped.",
    "Disabled ENA Express": "The express path is off.",
    "Enabled ENA Express without UDP": "The express path is on, but not for datagrams.",
    "Disabled ENA Express with Previously Enabled UDP": "The express path is off, although it is set for datagrams.",
    "ENA Express Enabled with UDP": "The express path is on, for datagrams too.",
    "Reduced Instructions per Cycle": "Each cycle does less work than in the base run. Look at caches, branches and stalls.",
    "High Branch Mispredictions": "Branches are often predicted wrong. Sorting data or avoiding branches in hot code may help.",
    "High L1 Instruction Cache Misses": "Code often is not in the first cache. Smaller or better laid out code may help.",
    "Instruction TLB Misses": "Addresses of code often are not at hand. Huge pages for code may help.",
    "Instruction TLB Table Walks": "Page tables are walked for code. Huge pages for code may help.",
    "High Code Sparsity": "Hot code is spread widely. Laying it out by a profile may help.",
    "High L1 Data Cache Misses": "Data often is not in the first cache. Look at how hot structures are laid out.",
    "High L2 Cache Misses": "Data often is not in the second cache. Look at the size of what is worked on.",
    "High L3 Cache Misses": "Data often has to come from memory. Look at the size of what is worked on.",
    "Data TLB Misses": "Addresses of data often are not at hand. Huge pages may help.",
    "Data TLB Table Walks": "Page tables are walked for data. Huge pages may help.",
    "Old-Style Atomic Instructions": "Atomic operations are made by exclusive loads and stores. Build for newer instructions.",
    "PMU Counter Collection Multiplexing": "Counters shared the hardware, so their values are in part estimates.",
    "Frontend-Dominated CPU Stalls": "The CPUs mostly waited for instructions. Look at the code's size and branches.",
    "Backend-Dominated CPU Stalls": "The CPUs mostly waited for data or units. Look at caches and memory.",
    "High Recorder Userspace CPU Time": "Recording itself took much time in user space and may have disturbed what it recorded.",
    "High Recorder Kernelspace CPU Time": "Recording itself took much time in the kernel and may have disturbed what it recorded.",
    "Kernel Version Mismatch": "The runs used different kernels.",
    "Inconsistent Number of CPUs": "The runs had different numbers of CPUs, so they can hardly be compared.",
    "Huge Page Disabled": "Transparent huge pages are not always on.",
    "PREEMPT_LAZY Detected": "The kernel preempts lazily, which can change latencies and throughput.",
    "Excessive Exceptions": "Much time goes into making exceptions. Avoid them where code runs often.",
    "Tiered Compilation Check": "With much code, tiered compilation may be worth turning on or off.",
    "JVM Version Comparison": "The runs used different Java machines.",
}


def rules_of(source: str, recorder: str | None = None) -> list:
    """The rules of a source, with their messages. Those on the recorder's own times look at the series ``recorder``, if given, else at the whole metric."""
    out = [StatThreshold(*x, series=recorder if source == "self_stats" else None) for x in THRESHOLDS.get(source, [])] + [RunComparison(*x) for x in COMPARISONS.get(source, [])]
    out += [PointThreshold(*x) for x in POINTS.get(source, [])] + [MetricComparison(*x) for x in PAIRS.get(source, [])] + OTHERS.get(source, [])
    return [replace(r, message=MESSAGES[r.name]) for r in out]


SOURCES = tuple(dict.fromkeys([*COMPARISONS, *THRESHOLDS, *POINTS, *PAIRS, *OTHERS]))
