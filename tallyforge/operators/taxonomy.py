"""Failure taxonomies: ordered rules over text, exit codes and directions (CLS-01 to CLS-05).

The first rule that holds names the primary category; later ones that hold too are secondaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of precedence, with the patterns that name them (case does not matter in these).
BUILD = {
    "retained_cuda_api": (
        r"cudaMalloc|cudaFree|cudaMemcpy|cudaMemset|cudaDeviceSynchronize|__global__|__device__|__shared__|<<<|>>>|cudaGetLastError|cudaSetDevice|cudaGetDevice|cuda_runtime\.h|cudaError_t|cudaSuccess"
        r"|blockIdx|threadIdx|blockDim|gridDim|__syncthreads|atomicAdd\b|atomicSub\b|atomicExch\b|atomicMin\b|atomicMax\b|atomicCAS\b|calling a __device__ function.*from a __host__"
    ),
    "retained_cuda_types": r"\bfloat3\b|\bfloat4\b|\bint3\b|\bint4\b|\bdouble3\b|\bdouble4\b|\bdim3\b|cudaStream_t|cudaEvent_t|texture<|surf<|__constant__",
    "retained_opencl_api": r"clCreateBuffer|clEnqueueWriteBuffer|clEnqueueReadBuffer|clBuildProgram|clCreateKernel|clSetKernelArg|clEnqueueNDRangeKernel|clReleaseMemObject|get_global_id|get_local_id|__kernel\b|cl_mem\b",
    "missing_target_api": None,
    "missing_header": r"No such file or directory|fatal error:.*not found|cannot find.*include",
    "linker_error": r"undefined reference to|multiple definition of|collect2:.*error|ld returned \d+ exit",
    "undeclared_identifier": r"\bundeclared\b|was not declared in this scope|identifier.*is undefined|does not name a type|unknown type name|has no member named",
    "type_mismatch": (
        r"cannot convert|incompatible type|no matching function|conflicting types|array subscript is not an integer|no viable conversion|no instance of overloaded|invalid.*operands? to binary|cannot be used to initialize"
    ),
    "syntax_error": (
        r"expected.*before|expected.*token|expected a [\"'(]|expected a declaration|stray.*in program|parse error|unterminated|invalid.*form.*pragma|is not valid for.*#pragma|must be closely nested"
        r"|too few arguments to function|too many arguments (?:to function|in function call)|no storage class or type specifier|missing closing quote"
    ),
    "implicit_declaration": r"implicit declaration of function",
    "redefinition": r"redefinition of|redeclaration of|duplicate member|previously declared here",
}
#: Categories that say nothing where the target is that API.
NOT_FOR_TARGET = {"retained_cuda_api": "cuda", "retained_cuda_types": "cuda", "retained_opencl_api": "opencl"}
#: What a translation into an API has to contain.
TARGET_SIGNS = {"omp": r"#pragma\s+omp\s+parallel|#pragma\s+omp\s+for", "opencl": r"__kernel\b|get_global_id", "cuda": r"__global__|<<<", "omp_target": r"#pragma\s+omp\s+target"}
EXTRACTION = {"no_code_blocks": r"did not contain parseable code", "missing_files": r"expected file|not found in output|missing.*file|could not find|no .* file"}
DATA_FILE = r"error opening|file not found|cannot open"


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def lacks_target_api(files: Column, target_api: Column) -> Column:
    """Whether a translation has files, and none with a construct of its target API."""
    code = F.array_join(F.map_values(files), "\n")
    lacks = F.lit(False)
    for api, sign in TARGET_SIGNS.items():
        lacks = F.when(target_api == api, ~code.rlike(sign)).otherwise(lacks)
    return F.coalesce((F.size(files) > 0) & lacks, F.lit(False))


def build_rules(snippet: Column, direction: Column, files: Column | None = None) -> list[tuple[str, Column]]:
    """CLS-01. Without ``files`` the rule about missing constructs does not hold."""
    target = F.substring_index(direction, "-to-", -1)
    out = []
    for name, pattern in BUILD.items():
        holds = _says(snippet, pattern) if pattern else F.lit(False) if files is None else lacks_target_api(files, target)
        out.append((name, holds & (target != NOT_FOR_TARGET[name]) if name in NOT_FOR_TARGET else holds))
    return out


def run_rules(exit_code: Column, stderr: Column, stdout: Column) -> list[tuple[str, Column]]:
    """CLS-02; these patterns mind the case, but for the checksum's."""
    err, out = F.coalesce(stderr, F.lit("")), F.coalesce(stdout, F.lit(""))
    either = lambda pattern: err.rlike(pattern) | out.rlike(pattern)
    code = lambda n: F.coalesce(exit_code == n, F.lit(False))
    # fixed values, as above
    return [
        ("wrong_checksum", _says(out, "INAVALID CHECKSUM|INVALID CHECKSUM")),
        ("wrong_args", either("[Uu]sage:") | err.rlike("<grid_rows|<sim_time|<temp_file|<power_file|<penalty>") | out.rlike("<inputfile>|<num of frames>")),
        ("opencl_jit_error", err.rlike(r"\d+\s+errors? generated")),
        ("simulation_mode_unsupported", out.rlike("not implemented.*OpenMP|History-based simulation not implemented")),
        ("gpu_memory_error", either("illegal memory access|GPUassert")),
        ("segfault", code(-11) | err.rlike("Segmentation fault|SIGSEGV|signal 11")),
        ("abort", code(-6) | err.rlike("stack smashing|SIGABRT|Aborted|signal 6")),
        ("timeout", err.rlike("TIMEOUT|exceeded timeout|killed.*timeout") | out.rlike("TIMEOUT")),
        ("data_file_missing", either(DATA_FILE)),
        ("wrong_exit_code", F.coalesce(exit_code != 0, F.lit(False))),
    ]


def primary(rules: list[tuple[str, Column]], other: str) -> Column:
    """The first rule that holds; an ordered CASE, so later ones are not tried."""
    out = F.lit(other)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def holding(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order; each is tried once. To be kept in a column of its own before it is used twice."""
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in rules]))


def first_of(found: Column, other: str) -> Column:
    """The primary category of ``holding``."""
    return F.coalesce(F.get(found, F.lit(0)), F.lit(other))


def others_of(found: Column, never: tuple[str, ...] = ()) -> Column:
    """The secondaries of ``holding``: all but the first, and but those that only serve as primary."""
    later = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
    return F.filter(later, lambda x: ~x.isin(*never)) if never else later


def extraction_category(message: Column) -> Column:
    """CLS-03."""
    return primary([(name, _says(message, pattern)) for name, pattern in EXTRACTION.items()], "malformed_output")


def verify_category(status: Column, stdout: Column) -> Column:
    """CLS-04."""
    blank = F.coalesce(stdout, F.lit("")).rlike(r"^\s*$")
    return (
        F.when(status == "pass", "pass_overall_mislabel").when(status == "error", "verification_error").when((status == "fail") & blank, "missing_output")
        .when(status == "fail", "wrong_numerical_output").otherwise("other_verify")
    )


def data_file_error(stdout: Column) -> Column:
    """CLS-04's secondary."""
    return _says(stdout, DATA_FILE)


def expected_error(line: Column, known: tuple[str, ...]) -> Column:
    """CLS-05: whether a log line is one of the known ones."""
    return F.exists(F.array(*map(F.lit, known)), lambda p: line.contains(p))
