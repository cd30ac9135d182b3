"""Constants, word lists, templates and messages that results depend on.

They are part of the computed results (order, wording and spacing included), so they are stated
here as plain text and nowhere else.
"""

from __future__ import annotations

# Columns of an operation record, in their order, and the required subsets.
OPERATION_COLUMNS = ("service", "service_name", "api_version", "operation", "description")
TRAINING_COLUMNS = ("service", "operation", "description")
INTENT_COLUMNS = ("service", "description")

# The services ingested unless the caller names others; records follow this order.
DEFAULT_SERVICES = (
    "ec2",
    "lambda",
    "s3",
    "efs",
    "rds",
    "dynamodb",
    "cloudfront",
    "iam",
    "secretsmanager",
    "wafv2",
    "shield",
    "guardduty",
    "inspector2",
    "securityhub",
    "cloudwatch",
    "logs",
    "cloudtrail",
    "config",
    "sns",
    "events",
    "stepfunctions",
    "ecs",
    "eks",
    "ecr",
    "athena",
    "glue",
)

# Spellings of a missing value in a CSV field (besides the empty field).
MISSING_TOKENS = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Chunking, retrieval, training and gating defaults.
CHUNK_SIZE = 100
CHUNK_OVERLAP = 20
TOP_N = 5
TOP_PREDICTIONS = 3
INTENT_WEIGHT = 3
RANDOM_SEED = 42
TEST_SHARE = 0.2
MAX_ITERATIONS = 2000
MINIMUM_CONFIDENCE = 0.12
MINIMUM_MARGIN = 0.03
CONTEXT_PREVIEW = 500

# Substrings that make a request a recommendation request; words that end a session.
RECOMMENDATION_MARKERS = (
    "i need",
    "which service",
    "what service",
    "recommend",
    "what should i use",
    "best service",
)
EXIT_COMMANDS = ("exit", "quit")

# Names of the training variants and of the two test sets in evaluation tables.
BASE_ONLY = "pre_intents"
WITH_EXTRA = "post_intents"
BASE_TEST_SET = "botocore"
EXTRA_TEST_SET = "intents"

# Statuses of an answered request.
REJECTED = "input_rejected"
CLARIFICATION = "clarification_required"
COMPLETED = "completed"

# Time format of the interaction log.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Messages.
MISSING_COLUMNS = "Missing required columns: {columns}"
MISSING_INTENT_COLUMNS = "Missing intent columns: {columns}"
INTENT_NULLS = "Intent data contains missing values."
INTENT_BLANKS = "Intent data contains empty values in: {columns}"
UNKNOWN_SERVICES = "Intent data contains unknown services: {services}"
CHUNK_SIZE_POSITIVE = "chunk_size must be greater than zero"
OVERLAP_NOT_NEGATIVE = "overlap cannot be negative"
OVERLAP_BELOW_SIZE = "overlap must be smaller than chunk_size"
TOP_N_POSITIVE = "top_n must be greater than zero."
WEIGHT_POSITIVE = "Intent weight must be at least 1."
EMPTY_INPUT = "Input must not be empty."
EMPTY_QUERY = "Query must not be empty."
EMPTY_REQUEST = "Please enter an AWS requirement."
NO_PREDICTIONS = "Classifier predictions cannot be empty."
FOLDER_NOT_FOUND = "Knowledge-base directory not found: {path}"
NO_DOCUMENTS = "No .txt documents found in: {path}"

# Fixed value: the reply that asks for clarification; %s are the two best services, upper-cased.
CLARIFICATION_REPLY = (
    "I'm currently deciding between %s and %s, but I don't have enough confidence to recommend "
    "one yet. Could you describe the workload or resource involved and the specific outcome you "
    "need?"
)

# Fixed value: opening of a recommendation reply; %s are the service and its percentage.
RECOMMENDATION_REPLY = "The classifier suggests %s with %s confidence. "

# The prompt and its two instruction variants; indentation is part of the text.
# %s in the first are the top service and the classifier output lines; %s in the last are the
# instructions and the context.
RECOMMENDATION_INSTRUCTIONS = """
            The user is requesting an AWS service recommendation.

            The classifier's top suggestion is %s.
            Explain why this service may suit the user's requirement, but only
            when that explanation is supported by the supplied context.

            Do not replace the classifier's top suggestion with another service.
            If the context does not support the suggestion, state that the
            available context is insufficient.

            CLASSIFIER OUTPUT:
            ==================

            %s
            """
GENERAL_INSTRUCTIONS = """
            The user is asking a general AWS certification question.

            Answer the user's question directly using the supplied context.
            Do not mention the classifier or its predictions.
            Do not turn the answer into a recommendation for one AWS service.
            """
SYSTEM_PROMPT = """
        You are a helpful AWS certification assistant.

        REQUEST INSTRUCTIONS:
        =====================

        %s

        GROUNDING RULES:
        ================

        - Answer using only information supported by the supplied context.
        - Do not invent AWS services, features, facts, or exam content.
        - Treat classifier predictions as suggestions, not factual evidence.
        - Do not claim that an AWS service exists unless it is named in the context.
        - If the context does not contain enough information, clearly state that
        the available context is insufficient.
        - Answer the user's exact question.
        - Produce a complete answer and do not end mid-sentence.
        - Reply in two to four short, friendly and informative sentences.

        SUPPLIED CONTEXT:
        =================

        %s

        END OF CONTEXT
        ==============
        """
