"""Schemas, class lists and feature sets of the event data."""

from __future__ import annotations

#: Fixed values of the data format: classes in order, open pitches of strings 6 to 1, fingers.
CLASSES = ("clean", "buzz", "muted")
OPEN_MIDI = {6: 40, 5: 45, 4: 50, 3: 55, 2: 59, 1: 64}
FINGERS = ("index", "middle", "ring", "pinky")
NOT_APPLICABLE, OPEN_OR_CHORD = -1, 0

#: Feature names in order.
AUDIO_FEATURES = (
    "spec_centroid spec_bandwidth spec_flatness spec_rolloff spec_flux zcr rms log_attack_time attack_slope decay_rate hnr inharmonicity buzz_band_ratio pitch_cents_dev chroma_peak".split()
    + [f"mfcc_{i}" for i in range(1, 14)]
)
VISION_FEATURES = "d_active d_index d_middle d_ring d_pinky string_est fret_est finger_curl_active finger_curl_mean wrist_angle neck_angle hand_conf reproj_px".split()
RESIDUAL_FEATURES = "res_energy_ratio res_centroid res_flatness res_highband_ratio res_rolloff perc_ratio".split() + [f"res_mfcc_{i}" for i in range(1, 6)]
FUSED_FEATURES = [*AUDIO_FEATURES, *VISION_FEATURES]

#: The columns of a run and of an event in order.
RUN_DDL = (
    "run_id string, session_id string, player_id string, app_version string, block string, string string, s_num int, fret_range string, frets array<int>, finger string, "
    "intended_class string, intended_placement string, pluck_strength string, pluck_variant string, pose_variant string, chord_name string, is_arpeggio boolean, is_strum boolean, "
    "pass int, held_out boolean, expected_note_count int, matched_intent string, room string, notes string, bpm double, beat_times_ms array<double>, recorded_at string, duration_ms double, t0_perf_ms double, "
    "audio struct<sample_rate:int,channels:int,format:string,peak_dbfs:double,clipped:boolean,clip_samples:int,silent:boolean>, "
    "video struct<present:boolean,width:int,height:int,frame_rate:double,mime:string>, devices struct<mic_label:string,cam_label:string>, aruco_marker_present boolean, audio_only boolean, sync string, "
    "files struct<audio:string,audio_bytes:bigint,video:string,video_bytes:bigint>, chord_sequence array<struct<chord:string,shape:array<int>,fingers:array<int>,cue_ms:double>>"
)
EVENT_DDL = (
    "event_id string, run_id string, session_id string, player_id string, block string, pass int, held_out boolean, intended_class string, intended_placement string, string_num int, target_fret int, "
    "finger string, pluck_strength string, onset_s double, dur_s double, f0_hz double, f0_midi double, f0_string_est int, f0_fret_est int, label_fret_match boolean, audio_peak_dbfs double, "
    "audio_clipped boolean, audio_silent boolean, wav_path string, video_path string, video_frame_rate double, guitar_id string, chord_name string, chord_shape string, chord_fingers string"
)
